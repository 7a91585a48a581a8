"""Embedding and text near-duplicates against brute force."""

import random
import threading
from contextlib import suppress
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import types as T

from weft.llm import dart_minhash, grams, rp_forest

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("h", T.StringType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType())])


def _brute(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_forest_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 16))
    rows = np.concatenate([base, base[:60] + 0.2 * rng.standard_normal((60, 16)), base[:20], base[:5] * 3, rng.standard_normal((1, 16)) + 0.01 * rng.standard_normal((80, 16))]).astype(np.float32)
    data = [(i, [float(x) for x in v], "x") for i, v in enumerate(rows)]
    got = {r["id"]: r for r in rp_forest.near_duplicates(spark.createDataFrame(data, VECTORS), leaf_size=40).collect()}
    unit = rows.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert {i: r["n_links"] for i, r in got.items()} == dict(enumerate(near.sum(1)))
    truth = _brute(range(len(rows)), zip(*np.nonzero(near), strict=True))
    assert {i: r["component_id"] for i, r in got.items()} == truth
    assert all(r["kept"] == (i == truth[i]) for i, r in got.items())


def test_forest_recall_in_many_leaves(spark):
    """2,500 pairs just above the threshold and a dense group around it, in leaves far smaller than the table: no link is lost."""
    rng, dim = np.random.default_rng(8), 32
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    aside = lambda base: unit((lambda x: x - (x * base).sum(1, keepdims=True) * base)(rng.standard_normal(base.shape)))
    base, centre = unit(rng.standard_normal((2_500, dim))), np.repeat(unit(rng.standard_normal((1, dim))), 500, axis=0)
    c = rng.uniform(0.9005, 0.91, (2_500, 1))
    rows = np.concatenate([base, c * base + (1 - c * c) ** 0.5 * aside(base), unit(centre + (1 / 0.9 - 1) ** 0.5 * aside(centre))]).astype(np.float32)
    data = [(i, v.tolist(), "x") for i, v in enumerate(rows)]
    got = {r["id"]: r["n_links"] for r in rp_forest.near_duplicates(spark.createDataFrame(data, VECTORS), leaf_size=256).collect()}
    own = unit(rows.astype(np.float64))
    near = own @ own.T >= 0.9
    np.fill_diagonal(near, False)
    assert got == dict(enumerate(near.sum(1)))


def _workers_mb(spark):
    """MB held by the largest Python worker of the session."""
    todo, most = [spark.sparkContext._gateway.proc.pid], 0
    while todo:
        pid = todo.pop()
        with suppress(OSError):
            todo += [int(x) for f in Path(f"/proc/{pid}/task").glob("*/children") for x in f.read_text().split()]
            if "pyspark.daemon" in Path(f"/proc/{pid}/cmdline").read_text():
                most = max(most, int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * 4096 >> 20)
    return most


@pytest.mark.skipif(not Path("/proc/self/task").exists(), reason="memory of the workers is read from /proc")
def test_forest_holds_a_dense_group(spark):
    """7,000 distinct vectors that all link: a task's memory doesn't grow with their links."""
    rng, n = np.random.default_rng(3), 7_000
    rows = (rng.standard_normal(16) + 0.05 * rng.standard_normal((n, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], VECTORS)
    most, over = [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], _workers_mb(spark))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = rp_forest.near_duplicates(df).groupBy("n_links", "component_id").count().collect()
    finally:
        over.set()
        watcher.join()
    assert [tuple(r) for r in got] == [(n - 1, 0, n)]
    assert 0 < most[0] < 700


def test_forest_deals_a_large_leaf_in_parts(spark):
    """A group that no direction divides, larger than a task's share: every two of its parts meet."""
    rng = np.random.default_rng(6)
    rows = np.concatenate([rng.standard_normal(16) + 0.2 * rng.standard_normal((700, 16)), rng.standard_normal((100, 16))]).astype(np.float32)
    rows = np.concatenate([rows, rows[:30]])
    unit = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert rp_forest.Forest(rows.astype(np.float64), 16, 1.0, 8, 0.056, 14, 17).parts.max() > 2
    got = rp_forest.near_duplicates(spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], VECTORS), leaf_size=8).collect()
    assert {r["id"]: r["n_links"] for r in got} == dict(enumerate(near.sum(1)))
    assert {r["id"]: r["component_id"] for r in got} == _brute(range(len(rows)), zip(*np.nonzero(near), strict=True))


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_forest_counts_each_link_once(monkeypatch, held):
    """Branch by branch, with few links held at once or all of them."""
    monkeypatch.setattr(rp_forest, "_HELD", held)
    monkeypatch.setattr(rp_forest, "_BRANCH", 4)
    rng = np.random.default_rng(9)
    rows = np.concatenate([rng.standard_normal((1_500, 24)), rng.standard_normal(24) + 0.25 * rng.standard_normal((400, 24)), np.repeat(rng.standard_normal((40, 24)), 5, axis=0) + 0.2 * rng.standard_normal((200, 24))])
    unit = rp_forest._unit(rows)
    forest = rp_forest.Forest(rows, 24, 1.0, 100, 0.5 * 0.2**0.5 / 24**0.5, 10, 1)
    row, branch = forest.deal(unit)
    assert len(forest.heads) > 40
    links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for b in range(len(forest.heads)):
        own = np.sort(row[branch == b])
        found, least = rp_forest._links(forest, b, None, np.ones(len(own)), unit[own], 0.9)
        links[own] += found
        root = rp_forest._local_roots(len(rows), np.concatenate([own, np.arange(len(rows))]), np.concatenate([own[least], root]))
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert (links == near.sum(1)).all()
    assert dict(enumerate(root)) == _brute(range(len(rows)), zip(*np.nonzero(near), strict=True))


def test_forest_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    data = [(1, None, None), (2, [], None), (3, [0.0, 0.0], None), (4, [1.0, None], None), (5, [nan, 1.0], None), (6, [inf, 1.0], None), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], None), (None, [1.0, 0.0], None), (10, [1e30, 1e25], None)]
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rp_forest.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()}
    assert got[7] == (2, 7, True) and got[8] == (2, 7, False) and got[10] == (2, 7, False)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)) and got[None] == (0, None, False)
    assert rp_forest.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def _texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    out = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(40)]
    passage = " ".join(word() for _ in range(60))
    for k in range(30):
        words = out[k].split()
        for _ in range(max(1, len(words) // rng.choice((15, 40, 200)))):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    base = " ".join(word() for _ in range(150)).split()
    for _ in range(60):  # a large group of near copies
        own = list(base)
        own[rng.randrange(150)] = word()
        out.append(" ".join(own))
    out += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(40)]  # a passage in many
    return out + out[:10] + ["a b", "a b", "a  b\n", "one", "", "  "]


def _jaccard_links(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]


@pytest.mark.parametrize("small", [4, 16])
def test_minhash_matches_brute_force(spark, small):
    texts = _texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r["id"]: r["component_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, DOCS), small=small).collect()}
    assert got == _brute(range(len(texts)), _jaccard_links(texts))


def test_minhash_edge_cases(spark):
    rows = [(1, None, "x"), (2, None, "x"), (3, "", "x"), (4, "a b c", "x"), (5, "a b c", "x"), (None, "a b c", "x"), (4, "a b c", "x"), (6, "long " * 50_000, "x"), (7, "long " * 50_001, "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in dart_minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 4, False), (None, None, False), (6, 6, True), (7, 6, False)], key=str)
    kept = [r["doc_id"] for r in dart_minhash.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == [1, 2, 3, 4, 6, None]
    assert dart_minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    x, y = rng.uniform(0, 4, 60), rng.uniform(0, 4, 60)
    darts = dart_minhash.Darts(2000)
    sig = darts.signatures(np.repeat([0, 1], 60), np.concatenate([elements, elements]), 2, np.concatenate([x, y]))
    assert abs((sig[0] == sig[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04
    alone = darts.signatures(np.zeros(60, int), elements, 1, x)
    assert (alone[0] == sig[0]).all()  # not changed by other sets


def test_shingles_do_not_depend_on_the_batch():
    texts = [t.encode() for t in _texts()]
    owner, values = grams.shingles(texts)
    for k in (0, 5, 17, len(texts) - 4):
        assert (grams.shingles([texts[k]])[1] == values[owner == k]).all()
