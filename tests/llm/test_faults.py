"""Cases that once went wrong: repeated rows, clashing names, large ids, long windows, other vocabularies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import best_fit_packing, budget_mix, chat_events, dart_minhash, grams, rp_forest, suffix_dedup


def test_a_repeated_vector_is_no_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {tuple(r) for r in rp_forest.near_duplicates(df).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}


def test_an_id_of_two_vectors_has_one(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = rp_forest.near_duplicates(df).collect()
    assert len(got) == 4 and len({tuple(r) for r in got if r["id"] == 1}) == 1 and sum(r["n_links"] for r in got if r["id"] > 1) == 1


def test_mix_of_clashing_names(spark):
    df = spark.createDataFrame([(k, "one two three", "a" if k % 3 else "b") for k in range(30)], "doc_id long, text string, source string")
    for name in ("target", "total", "own", "rounds", "quota", "n", "before"):
        df = df.withColumn(name, F.lit(name))
    assert budget_mix.mix(df).count() == 30 and budget_mix.apply_mix(df).columns == df.columns


def test_large_conversation_ids_beside_a_null(spark):
    big = (1 << 53) + 1
    turns = spark.createDataFrame([(big, 0, "user", "a"), (None, 0, "user", "b"), (big, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    got = chat_events.digest(chat_events.render(chat_events.fold_events(chat_events.as_events(turns)))).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in got} == {(big, 2), (None, 1)}


def test_windows_of_300_bytes(spark):
    text = "".join(chr(97 + (k * k) % 23) + str(k) for k in range(200))
    df = spark.createDataFrame([(1, text), (2, "x" + text), (3, text[:299])], "doc_id long, text string")
    got = {r["doc_id"]: r["__spans"] for r in suffix_dedup.remove_repeats(df, length=300).collect()}
    assert got[1] == [] and [tuple(s) for s in got[2]] == [(1, len(text) + 1)] and got[3] == []
    for bad in ({"length": 10}, {"slice_bytes": 1 << 24}):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(df, **bad)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_any_vocabulary(name):
    import public_tokenizers

    coder = best_fit_packing.WordTokenizer(public_tokenizers.path(name))
    texts = ["Don't stop, it's 1999!", "", " a\tb\n\nc ", "<|endoftext|> x", "Σας é́ ①½", "word" * 500, "a b　c"]
    assert coder.ids(texts) == [np.array(coder.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.by_runs == (name == "word_bpe_49k.json")


@pytest.mark.parametrize("block", [(512, 2048), (3, 5)])
def test_hot_near_copies_against_brute_force(spark, block):
    """A large group of near copies, many of which link with few others or none: buckets are far beyond `small`."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(150):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            own[at] = f"x{rng.integers(0, 10**9)}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert len(set(root)) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in dart_minhash.near_duplicates(df, small=4, block=block).collect()}
    assert [got[k] for k in range(len(texts))] == root


def _twins(n=1024):
    """A Thue-Morse word and its inverse: polynomial hashes modulo 2**64 take them for one."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_under_a_polynomial(spark):
    one, two = _twins()
    df = spark.createDataFrame([(1, one + " one"), (2, two + " one"), (3, one + " one"), (4, " ".join([one] * 3 + ["x"] * 40)), (5, " ".join([two] * 3 + ["x"] * 40))], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in dart_minhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert len(set(grams.word_hashes([one.encode(), two.encode()])[0].tolist())) == 2


@pytest.mark.parametrize("hot", [1, 2, 100_000])
def test_windows_that_collide_under_a_polynomial(spark, hot):
    one, two = _twins()
    df = spark.createDataFrame([(1, one), (2, two), (3, "c" + two)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["__spans"]] for r in suffix_dedup.remove_repeats(df, length=1024, hot=hot).collect()}
    assert got == {1: [], 2: [], 3: [(1, 1025)]}


def test_exact_shingles_when_every_hash_collides(monkeypatch):
    """The numbers of shingles rest on words, whatever the hash does."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "cc", "a" * 9, "a" * 8 + "b"], n)).encode() for n in (0, 1, 3, 4, 5, 6, 40, 40)]
    texts += [texts[3], b" \t a\x0bb "]

    def sets():
        owner, numbers = grams.exact_shingles(texts)
        return [set(numbers[owner == k].tolist()) for k in range(len(texts))]

    words = [[w for w in t.replace(b"\x0b", b" ").split(b" ") if w.strip()] for t in texts]
    want = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    for _ in range(2):
        got = sets()
        assert [[len(a & b) for a in got] for b in got] == [[len(a & b) for a in want] for b in want]
        monkeypatch.setattr(grams, "mix", lambda x: x & np.uint64(0))


def test_words_of_runs_are_merged_once(monkeypatch):
    """Runs that differ by what stands around a word share its merges, also when the words' cache is emptied in between."""
    import public_tokenizers

    from weft.llm.best_fit_packing import WordTokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    for room in (32 << 20, 2_000):
        own = WordTokenizer(path, room)
        merged, merge = [], own.merge
        own.merge = lambda word, merged=merged, merge=merge: merged.append(word) or merge(word)
        texts = ["Zymurgical, zymurgical. (zymurgical) ZYMURGICAL!", "zymurgical's été, ÉTÉ; été", "don't --'s 12a͸b zymurgical"]
        assert own.ids(texts) == [b"".join(i.to_bytes(4, "little") for i in own.whole.encode(t, add_special_tokens=False).ids) for t in texts]
        if room > 2_000:
            assert merged.count("zymurgical") == 1
