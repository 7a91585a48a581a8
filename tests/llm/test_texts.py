"""Language, quality and toxicity: held-out accuracy, and the field and the trees against plain versions."""

import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import crf_toxicity, mil_quality, ppm_language

SF = "/root/testdata/sf0.01"


def _plain_ppm(text, train, a_map, kept):
    """Bits of a text under order-3 PPM with method C and exclusion, as the definition has it."""
    counts = {}
    for t in train:
        s = b"\0\0\0" + t
        for k in range(3, len(s)):
            for order in range(4):
                ctx = tuple(a_map[b] for b in s[k - order : k])
                counts.setdefault(ctx, {}).setdefault(a_map[s[k]], 0)
                counts[ctx][a_map[s[k]]] += 1
    total, s = 0.0, b"\0\0\0" + text
    rest = 256 - max(a_map)
    for k in range(3, len(s)):
        sym, p, out = a_map[s[k]], 1.0, set()
        for order in (3, 2, 1, 0):
            ctx = tuple(a_map[b] for b in s[k - order : k])
            if ctx not in kept:
                continue
            own = {x: n for x, n in counts.get(ctx, {}).items() if x not in out}
            if not own:
                continue
            t, q = sum(own.values()), len(own)
            if sym in own:
                p *= own[sym] / (t + q)
                break
            p *= q / (t + q)
            out |= set(own)
        else:
            left = sum(rest if x == 0 else 1 for x in range(max(a_map) + 1) if x not in out)
            p *= 1 / left
        total -= math.log2(p) if sym in out or True else 0
    return total


def test_code_lengths_match_the_definition():
    train = {"x": [b"abracadabra banana", b"cabana band"], "y": [b"zebra zoo zigzag zaza", b"zoozoo"]}
    for most in (1 << 16, 9):
        trees = ppm_language.ContextTrees(train, most)
        for k, lang in enumerate(trees.langs):
            a_map, uses = trees.trees[k].symbol.tolist(), {}
            for t in train[lang]:
                s = b"\0\0\0" + t
                for at in range(3, len(s)):
                    for order in range(4):
                        ctx = tuple(a_map[b] for b in s[at - order : at])
                        uses[ctx] = uses.get(ctx, 0) + 1
            threes = sorted((c for c in uses if len(c) == 3), key=lambda c: (-uses[c], c))
            kept = {c for c in uses if len(c) < 3} | set(threes[:most])
            for text in (b"banana zoo", b"", b"q", b"zaz\xff\xfe abra" * 5):
                got = trees.code_lengths([text])[0] / (1 << 16)
                assert got[k] == pytest.approx(_plain_ppm(text, train[lang], a_map, kept), abs=1e-3 * (len(text) + 1))


def test_a_language_does_not_depend_on_the_others():
    one = {"x": [b"abracadabra banana"]}
    alone, among = ppm_language.ContextTrees(one), ppm_language.ContextTrees(one | {f"y{k}": [f"zoo {k}".encode()] for k in range(20)})
    texts = [b"banana", b"zoo 3", "жук".encode()]
    assert (alone.code_lengths(texts)[:, 0] == among.code_lengths(texts)[:, 0]).all()


def test_code_lengths_do_not_depend_on_blocks():
    trees = ppm_language.ContextTrees({"x": [b"abc abd abe"], "y": [b"xyz xya"]})
    texts = [b"abc" * 9000, b"", b"xyz xyz", b"\xf0" * 20_000]
    whole = trees.code_lengths(texts)
    assert (whole == np.concatenate([trees.code_lengths([t], 1 << 14) for t in texts])).all()


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ppm_language.op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and held["score"].between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [(1, "the cat sat on the mat", "en"), (3, "der Hund und die Katze", "de"), (4, None, "en"), (5, "", None), (6, "123 !!", "en"), (None, "the cat", None), (7, "the cat " * 100_000, None), (7, "die Katze", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit("clash"))
    got = sorted(((r["id"], r["lang_pred"], r["score"] > 0) for r in ppm_language.identify(df).collect()), key=str)
    assert [g for g in got if g[0] in (4, 5, 6)] == [(i, "und", False) for i in (4, 5, 6)]
    assert len(got) == 8
    none = ppm_language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert ppm_language.identify(df.limit(0)).count() == 0


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    trans, start = rng.normal(size=(2, 2)), 0.3
    for n in (1, 2, 5):
        e = rng.normal(size=(n, 1))
        p = crf_toxicity.forward_backward(e, np.array([n]), trans, start)[2][:, 0]
        weight, hit = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            s = math.exp(sum(e[k, 0] * tags[k] for k in range(n)) + start * tags[0] + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            weight += s
            hit += s * np.array(tags)
        assert np.allclose(p, hit / weight)


def _labelled(got, labels, column):
    both = got.merge(labels.drop_duplicates("doc_id"), on="doc_id")
    return both[both["held_out"] & both[column].notna()]


def test_toxicity(spark):
    got = crf_toxicity.op7_toxicity(spark, SF).toPandas()
    held = _labelled(got, spark.read.parquet(f"{SF}/labels.parquet").toPandas(), "toxic")
    assert (held["predicted"] == held["toxic"]).mean() > 0.9
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")["text"]
    some = got[got["spans"].map(len) > 0].iloc[0]
    assert all(texts[some["doc_id"]][s["start"] : s["end"]].strip() for s in some["spans"])


def test_toxicity_fits_every_tagged_window():
    """Words that only the last toxic texts hold are learnt however many toxic texts come before."""
    rng = np.random.default_rng(5)
    text = lambda extra: " ".join([f"word{k}" for k in rng.integers(0, 300, 12)] + extra)
    clean, early, late = [text([]) for _ in range(1_500)], [text(["vile"]) for _ in range(2_600)], [text(["scoundrel"]) for _ in range(300)]
    field = crf_toxicity.train(clean + early + late, np.repeat([0, 1], [1_500, 2_900]))
    assert field.weights.get("wvile", 0.0) > 0 and field.weights.get("wscoundrel", 0.0) > 0
    p = field.marginals([crf_toxicity.words("word1 word2 scoundrel word3")])[0]
    assert p[2] > 0.5 and p[[0, 1, 3]].max() < 0.5


def test_toxicity_fit_does_not_depend_on_blocks():
    rng = np.random.default_rng(6)
    texts = [" ".join([f"word{k}" for k in rng.integers(0, 90, rng.integers(0, 200))] + ["vile"] * y) for y in (0, 1) for _ in range(60)]
    one, two = (crf_toxicity.train(texts, np.repeat([0, 1], 60), block=b) for b in (7, 4096))
    assert one.weights.keys() == two.weights.keys() and all(one.weights[f] == pytest.approx(w, rel=1e-6, abs=1e-9) for f, w in two.weights.items())


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(k, "you are a vile wretch today" if k % 2 else f"a fine day number {k}") for k in range(60)] + [(100, None), (101, ""), (102, "vile wretch " * 50_000), (None, "vile wretch"), (1, "you are a vile wretch today")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = crf_toxicity.tag(docs, labels).collect()
    assert len(got) == 65 and all(0 <= r["score"] <= 1 for r in got)
    none = crf_toxicity.tag(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert crf_toxicity.tag(docs.limit(0), labels).count() == 0
    assert crf_toxicity.drop_toxic(docs, labels.limit(0)).count() == 65


def test_attention_gradients():
    """Every slope against differences of the loss; the fit then separates the documents."""
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(n, mil_quality.WIDTH)) * 0.3 for n in (1, 3, 2)]
    y, weight = np.array([1, 0, 1]), np.array([0.2, 0.5, 0.3])
    x, starts, lens = np.concatenate(bags), np.array([0, 1, 4]), np.array([1, 3, 2])
    model = mil_quality.Attention(4, 3, 0)
    model.p["o"][:] = rng.normal(size=4)

    def loss():
        p = 1 / (1 + np.exp(-model.forward(x, starts, lens)["logit"]))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    slopes = model.slope(x, starts, lens, y, weight)
    for name, value in model.p.items():
        for at in rng.integers(0, value.size, 12):
            was = value.flat[at]
            value.flat[at] = was + 1e-6
            high = loss()
            value.flat[at] = was - 1e-6
            low = loss()
            value.flat[at] = was
            assert slopes[name].flat[at] == pytest.approx((high - low) / 2e-6, abs=1e-7), name
    model.fit(bags, y, 60, 0.05, 0)
    assert ((model.forward(x, starts, lens)["logit"] > 0) == (y == 1)).all()


def test_attention_is_the_definition():
    """Scores of a short text by hand: softmax of gated units weighs the passage vectors."""
    model, text = mil_quality.Attention(4, 3, 1), "Some words.\n" * 70
    model.p["o"][:], model.p["b"][0] = [0.5, -1.0, 2.0, 0.1], 0.2
    x, p = mil_quality.encode(mil_quality.passages(text)).astype(float), model.p
    h = [np.tanh(row @ p["W"]) for row in x]
    e = [math.exp(sum(math.tanh(row @ p["V"][:, k]) / (1 + math.exp(-(row @ p["U"][:, k]))) * p["w"][k] for k in range(3))) for row in h]
    z = sum(a / sum(e) * row for a, row in zip(e, h, strict=True))
    assert len(x) > 1 and model.scores([text], 500)[0] == pytest.approx(1 / (1 + math.exp(-(z @ p["o"] + 0.2))))


def test_scores_take_whole_texts():
    model = mil_quality.Attention(4, 3, 0)
    model.p["o"][:] = 1.0
    long = "word and word. " * 200_000
    one = model.scores([long], 500)[0]
    x = mil_quality.encode(mil_quality.passages(long, 500)).astype(float)
    assert one == pytest.approx(1 / (1 + np.exp(-model.forward(x, np.array([0]), np.array([len(x)]))["logit"][0])))
    assert model.scores(["", long, "x"], 500)[1] == pytest.approx(one)


def test_quality(spark):
    got = mil_quality.op3_quality(spark, SF).toPandas()
    held = _labelled(got, spark.read.parquet(f"{SF}/labels.parquet").toPandas(), "quality")
    assert (held["predicted"] == held["quality"]).mean() > 0.9


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(k, "calm words here. " * 9 if k % 2 else "@@ ## !! " * 9) for k in range(60)] + [(100, None), (101, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, None)], "doc_id long, quality int")
    got = {r["id"]: r["score"] for r in mil_quality.classify(docs, labels).collect()}
    assert len(got) == 63 and got[1] > 0.7 > got[2] and got[100] == got[101]
    assert {r["score"] for r in mil_quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert mil_quality.classify(docs.limit(0), labels).count() == 0
