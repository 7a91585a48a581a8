"""The trie, point-in-time features and weak quality against their SQL and plain definitions, over nasty rows."""

import collections
import datetime
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.llm import asof_features, prefix_trie, scans, weak_quality


def _sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    out = con.sql(sql)
    return sorted(out.columns), out.to_arrow_table().to_pylist()


def _same(df, sql, **tables):
    columns, want = _sql(sql, **tables)
    key = lambda row: tuple(str(row[c]) for c in columns)
    assert sorted(map(key, (r.asDict() for r in df.select(*columns).collect()))) == sorted(map(key, want))


def test_scan(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, rng.randrange(10), rng.choice([None, rng.randrange(100)])) for i in range(-40, 160)]
    found = {(r.k, r.i): (r.s, r.m) for r in scans.carried(spark.createDataFrame(rows, "k long, i long, s long, m long"), ["k"], "i", ["s"], ["m"], block=7).collect()}
    for k, i, *_ in rows:
        before = [r for r in rows if r[0] == k and r[1] < i]
        assert found[k, i] == (sum(r[2] for r in before), max((r[3] for r in before if r[3] is not None), default=None))


def _talks():
    rng = random.Random(4)
    rows = []
    for c in [*range(40), -7, -5, -3, 10**12]:
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "a", "", None, "é\nb"]), 1))
    return rows + [(0, 1, "user", "a", 1)] * 3 + [(None, 0, "user", "x", 1)] + [(77, t, "user", str(t % 2), 1) for t in range(30)] + [(78, t, "user", str(t % 2), 1) for t in range(29)]


TALK = "conv_id long, turn long, role string, text string, pos int"


def test_trie_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    talks = spark.createDataFrame(_talks(), TALK)
    _same(prefix_trie.conversation_trie(talks), prefix_trie.ORACLE, conversations=talks)


def test_trie_pieces(spark):
    """Spans of turns, blocks of paths and spans of ids change nothing."""
    talks = spark.createDataFrame(_talks(), TALK)
    turns = prefix_trie.numbered(talks)
    assert sorted(map(tuple, prefix_trie.numbered(talks, span=3).collect())) == sorted(map(tuple, turns.collect()))
    rows = prefix_trie.prefixes(prefix_trie.rebuilt(turns))
    assert sorted(map(tuple, prefix_trie.trie(rows, block=2).select("conv_id", "depth", "saved_tokens", "n_leaves").collect())) == sorted(map(tuple, prefix_trie.trie(rows).select("conv_id", "depth", "saved_tokens", "n_leaves").collect()))
    ends = spark.createDataFrame([(1, "p", i) for i in (5, -3, 10, 9, 100)] + [(1, "q", 7)], "depth long, prefix string, conv_id long")
    assert {r.prefix: r.ends_sha256 for r in prefix_trie.ends_digest(ends, span=4).collect()} == {"p": sha256(b"-3,5,9,10,100").hexdigest(), "q": sha256(b"7").hexdigest()}


def test_empty_trie(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TALK)).count() == 0


def _shop(seed):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    at = lambda days: start + datetime.timedelta(seconds=rng.randrange(days * 86400 // 3600) * 3600)
    late = lambda t: t and t + datetime.timedelta(hours=rng.choice([0, 1, 4, 50, 400]))
    hole = lambda x, n=12: None if rng.randrange(n) == 0 else x
    client = lambda: rng.choice([7, 7, 7, 1, 2, 3, None])
    clicks, sales, lines = [], [], []
    for i in range(400):
        t = hole(at(40))
        clicks.append((hole(i, 30), t, hole(late(t)), client(), rng.choice(["purchase", "view", None]), rng.choice([None, 1.005, -2.5, 0.0, 19.99]), rng.choice(["{}", None]), i % 2))
    clicks += clicks[:50]
    for i in range(200):
        t = hole(at(40))
        sales.append((i, client(), "done", rng.choice([None, 10.25, 0.1]), t, hole(late(t)), 1, i))
    for i in range(900):
        s = rng.choice([5, 5, rng.randrange(210), None])
        lines.append((s, i % 9, rng.choice([1, 1, 2, 3, 4, None]), 1, 2, rng.choice([None, 3.335, 7.0]), 0.0, "x", hole(at(60)), 0))
    return clicks, sales, lines + lines[:100]


SHOP = {
    "clicks": "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, slice long",
    "sales": "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, id long",
    "sale_lines": "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, client long",
}


@pytest.mark.parametrize(("slice_rows", "task_rows"), [(50_000, 250_000), (20, 300)])
def test_features_equal_sql(spark, tmp_path, monkeypatch, slice_rows, task_rows):
    """Whole clients and clients cut into slices of time, with nulls, ties, late, repeated and broken rows and columns of inner names."""
    tables = {name: spark.createDataFrame(rows, SHOP[name]) for name, rows in zip(SHOP, _shop(3), strict=True)}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    whole = asof_features.point_in_time
    monkeypatch.setattr(asof_features, "point_in_time", lambda *frames: whole(*frames, slice_rows=slice_rows, task_rows=task_rows))
    _same(asof_features.op12_point_in_time(spark, str(tmp_path)), asof_features.ORACLE, **tables)


def test_features_of_empty_tables(spark):
    clicks, sales, lines = (spark.createDataFrame([], kind) for kind in SHOP.values())
    asks = spark.createDataFrame([(1, 7, 0), (2, None, 0)], "id long, client_id long, t long")
    found = asof_features.point_in_time(asks, clicks, sales, lines).collect()
    assert [(r.sale_id, r.d, r.label, r.n_clicks, r.last_click_id, r.line_cents) for r in sorted(found)] == [(1, 2, False, 0, None, 0), (1, 14, False, 0, None, 0)]
    assert asof_features.point_in_time(asks.limit(0), clicks, sales, lines).count() == 0


def test_times_ignore_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        at = datetime.datetime(2024, 3, 10, 2, 30, 1, 250)
        assert spark.createDataFrame([(at,)], "t timestamp_ntz").select(asof_features.micros(F.col("t"))).first()[0] == int((at - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def _texts():
    rng = random.Random(2)
    some = [" ".join(rng.choices(["a", "b", "c", "dé", "😀", "#x"], k=rng.choice([1, 2, 3, 4, 60, 300]))) for _ in range(60)]
    lines = ["\n".join(rng.choices(["one two three.", "x", " ", " ", "\x0b", "x ", ""], k=40)) for _ in range(10)]
    return [None, "", " ", "\n\n", "a b c a b c", "a a a a", " a\tb\x0bc\x0c\rd ", "#*$%&|<>", "word " * 30_000, *some, *lines, "\x1c\x85  ", "x"]


def test_measures(spark):
    rows = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string").select("text", weak_quality.measures(F.col("text")).alias("m")).select("text", "m.*").collect()
    for r in rows:
        assert tuple(r[1:6]) == _base(r.text), r.text


def test_windows_of_one_hash(spark, monkeypatch):
    """With a hash that is the same for all windows the count is still exact."""
    monkeypatch.setattr(F, "xxhash64", lambda *x: F.octet_length(x[0]).cast("long") * 0)
    rows = spark.createDataFrame([(t,) for t in _texts() if t and len(t) < 2000], "text string").select("text", weak_quality.repeated_words(weak_quality.words_of(F.col("text"))).alias("n")).collect()
    assert all(r.n == _base(r.text)[4] for r in rows)


def test_quality_equals_sql(spark):
    texts = [*_texts(), *["This is a fine line of text, it ends well.\n" * 1 + f"Number {i} is told here in {i * 7} words and more, again and again.\n" * (1 + i % 3) for i in range(80)]]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    _same(weak_quality.judge(docs), weak_quality.ORACLE, documents=docs)
    assert weak_quality.judge(docs.limit(0)).count() == 0


def test_quality_against_labels(spark):
    """No label is seen, yet what is kept is what the labels call good."""
    sf = "/root/testdata/sf0.01"
    judged = weak_quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert len(good) > 100 and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_crc():
    """What the SQL computes by shifts is the crc32 that Spark has."""
    text = re.search(r"xor\(list_reduce.*?4294967295\)", prefix_trie.ORACLE, re.S)[0].replace("l.conv_id", "x")
    found = duckdb.connect().sql(f"SELECT x, {text} AS crc FROM (VALUES (0), (-17), (123456789012)) AS v(x)").to_arrow_table().to_pylist()
    assert all(r["crc"] == zlib.crc32(str(r["x"]).encode()) for r in found)
