"""Suffix deduplication, mixing and packing against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import best_fit_packing as packing
from weft.llm import budget_mix, suffix_dedup

public_tokenizers = pytest.importorskip("public_tokenizers")


def _covered(texts, length):
    """Removed bytes by definition, for {id: text}."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            own = raw[s : s + length]
            if own in seen:
                gone[s : s + length] = True
            seen.add(own)
        out[i] = (raw, gone)
    return out


def _corpus(seed, n=60):
    rng = random.Random(seed)
    fresh = lambda k: "".join(rng.choices("abcde \né", k=k))
    shared = [fresh(k) for k in (99, 100, 101, 150, 400, 1000)]
    texts = {}
    for i in range(n):
        parts = [fresh(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), fresh(rng.choice((0, 1, 5, 120)))]
        texts[i * 3] = "".join(parts)
    texts[1000], texts[1001] = texts[3], texts[3] + "tail"
    texts[1002], texts[1003], texts[1004] = "a" * 250, "ab" * 200, None
    texts[1005], texts[1006] = "", fresh(30) + "a" * 120
    return texts


@pytest.mark.parametrize("options", [{}, {"hot": 3}, {"slice_bytes": 500}, {"slice_bytes": 300, "hot": 2}])
def test_removal_matches_the_definition(spark, options):
    texts = _corpus(len(str(options)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(df, **options).collect()}
    for i, (raw, gone) in _covered(texts, 100).items():
        r = got[i]
        assert bytes(r["__kept"]) == np.frombuffer(raw, np.uint8)[~gone].tobytes(), i
        assert len(r["__spans"]) == int((np.diff(gone.astype(int), prepend=0) == 1).sum()) and r["__n_bytes"] == len(raw)


def test_removal_edge_cases(spark):
    long = "".join(random.Random(0).choices("abcdefgh", k=300_000))
    rows = [(1, long), (2, long), (None, long), (3, "x" + long[5000:5099]), (4, "é" * 80), (5, "a" + "é" * 80), (1, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], len(r["text"])) for r in suffix_dedup.apply_removal(df).collect()), key=str)
    assert got == sorted([(1, 300_000), (1, 300_000), (2, 0), (None, 300_000), (3, 100), (4, 1), (5, 1)], key=str)
    assert suffix_dedup.apply_removal(df.limit(0)).count() == 0


def test_loser_tree_merges_with_shared_prefixes():
    rng = random.Random(2)
    runs, every = [], []
    for _ in range(7):
        own = sorted(bytes(rng.choices(b"ab", k=rng.randint(1, 40))) for _ in range(rng.randint(0, 50)))
        every += own
        items, last = [], b""
        for s in own:
            lcp = next((k for k in range(min(len(s), len(last))) if s[k] != last[k]), min(len(s), len(last))) if items else 0
            items.append((lcp, s, b"", [0], [0]))
            last = s
        runs.append(iter(items))
    out = list(suffix_dedup.merge(runs))
    assert [x[1] for x in out] == sorted(every)
    for a, b in zip(out, out[1:], strict=False):
        k = next((k for k in range(min(len(a[1]), len(b[1]))) if a[1][k] != b[1][k]), min(len(a[1]), len(b[1])))
        assert b[0] == k


@pytest.mark.parametrize("seed", range(40))
def test_fit_counts(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.choice(np.arange(0, 300), rng.integers(20, 60), replace=False)
    counts = rng.integers(1, 50, len(sizes))
    budget = int(rng.uniform(0, 1) * (sizes * counts).sum())
    taken = budget_mix.fit_counts(sizes, counts, budget)
    assert ((taken >= 0) & (taken <= counts)).all() and 0 <= budget - (taken * sizes).sum() <= 2


def test_fit_counts_above_the_programme():
    taken = budget_mix.fit_counts(np.array([3_000_000, 7, 5]), np.array([5, 10, 10]), 9_000_033, dp_limit=1000)
    assert abs((taken * np.array([3_000_000, 7, 5])).sum() - 9_000_033) <= 1


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, free = 1.5 * sum(sizes.values()), set(order)
    while free:
        left = total - sum(2 * sizes[s] for s in order if s not in free)
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if now[s] > 2 * sizes[s]}
        if not over:
            break
        free -= over
    return {s: now[s] if s in free else 2.0 * sizes[s] for s in order}


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "a", "a", "b", "ß", "Z", None, ""])) for i in range(700)]
    rows += [(900, None, "empty"), (901, "", "empty"), (None, "x y", "a"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = budget_mix.mix(df).collect()
    again = budget_mix.mix(df.repartition(7)).collect()
    key = lambda r: str((r["doc_id"], r["source"], r["__copies"]))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    aims = _targets(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["__source_size"] == sizes[s] and own[0]["__target"] == pytest.approx(aims[s])
        assert abs(sum(r["__copies"] * r["__size"] for r in own) - aims[s]) <= 2
        assert all(0 <= r["__copies"] <= 2 for r in own)
    assert budget_mix.apply_mix(df).count() == sum(r["__copies"] for r in got)
    assert budget_mix.mix(df.limit(0)).count() == 0


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_cache_gives_the_tokenizers_ids():
    rng = random.Random(4)
    pools = ["abc DEF ghi'll don't WE'RE 12 ½ ² ", "éàüßÉÀÜ ñ ", "ΑΒΣς σ ", "İıI ", "日本語 漢字カナ ", "\t\n\r\x0b\x0c\x1c\x85\xa0 ​ ", "_-'!?.,;$%&*#@ <|endoftext|> </w> ", "é ñ ́ ", "🎉👍🏽 ", "\x00\x7f "]
    texts = ["", " ", "<|startoftext|> a <|endoftext|>", "'s 't 'S IT'S it''s", "ΟΔΥΣΣΕΥΣ"]
    texts += ["".join(rng.choices(rng.choice(pools) + rng.choice(pools), k=rng.randint(1, 60))) for _ in range(3000)]
    coder = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), room=50)
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], coder.ids(texts[at : at + 500]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, text


def _best(items, capacity):
    """The least number of sequences, by trying."""
    best = [len(items)]

    def go(k, free):
        if len(free) >= best[0]:
            return
        if k == len(items):
            best[0] = len(free)
            return
        for j in {f: j for j, f in enumerate(free)}.values():
            if free[j] >= items[k]:
                go(k + 1, [*free[:j], free[j] - items[k], *free[j + 1 :]])
        go(k + 1, [*free, capacity - items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(1, 20) if seed % 2 else rng.randint(5, 20) for _ in range(rng.randint(0, 9))), reverse=True)
    counts = {n: items.count(n) for n in items}
    plan = packing.Plan(counts, 20)
    places = {}
    for length, rank, count, first, offset in plan.runs:
        for k in range(count):
            places.setdefault(first + k, []).append((offset, length, rank + k))
    assert sorted(x[1:] for own in places.values() for x in own) == sorted((n, k) for n, c in counts.items() for k in range(c))
    for own in places.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 20
    assert len(places) == plan.sequences
    least = _best(items, 20)
    assert plan.sequences <= least + (least > 2)
    # what the reduction fixes costs nothing: with the rest packed at best the whole is at best
    fixed = [length for length, rank, count, first, _ in plan.runs for k in range(count) if first + k < plan.fixed]
    rest = list(items)
    for length in fixed:
        rest.remove(length)
    assert plan.fixed + _best(rest, 20) == least


def test_packing(spark):
    rng = random.Random(6)
    texts = {i: "".join(rng.choices("ab é12 '!", k=rng.choice((0, 3, 50, 400)))) for i in range(300)}
    texts[400], texts[401] = None, "word " * 9000
    rows = list(texts.items()) + [(3, texts[3]), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.pack_documents(df).collect()
    for i, text in texts.items():
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r["id"] == i), key=lambda r: r["piece"])
        own = own[:: 2 if i == 3 else 1]
        assert [x for r in own for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist()] == ids
        assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["start"] == 4096 * r["piece"] and r["length"] == len(r["ids"]) // 4 for r in own)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_ids_of_every_character():
    """Whatever Unicode version a library knows: each code point gives the tokenizer's own ids, alone and inside a word."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"{chr(c)} a{chr(c)}b" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    found = packing.WordTokenizer(path).ids(texts)
    assert [t for t, f, w in zip(texts, found, want, strict=True) if f != np.array(w.ids, "<u4").tobytes()] == []
