"""Lossless WebP round trips over all parts of the format; chat logs against a plain fold."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import chat_events, lossless_webp as webp, media, webp_batch

RNG = np.random.default_rng(5)
PICTURES = {
    "noise": RNG.integers(0, 256, (13, 21, 4), dtype=np.uint8),
    "few colours": RNG.integers(0, 3, (17, 30, 1), dtype=np.uint8).repeat(4, 2) * 40,
    "repeats": np.tile(RNG.integers(0, 256, (4, 6, 4), dtype=np.uint8), (5, 5, 1)),
    "one pixel": RNG.integers(0, 256, (1, 1, 4), dtype=np.uint8),
    "flat": np.full((9, 40, 4), 7, np.uint8),
}


@pytest.mark.parametrize("name", PICTURES)
@pytest.mark.parametrize("transforms", [(), ("predictor",), ("cross_color",), ("subtract_green",), ("predictor", "cross_color", "subtract_green")])
@pytest.mark.parametrize("coding", [{}, {"refs": True}, {"cache_bits": 4}, {"refs": True, "cache_bits": 10}, {"meta_bits": 2}, {"refs": True, "cache_bits": 3, "meta_bits": 3}])
def test_round_trip(name, transforms, coding):
    assert (webp.decode(webp.encode(PICTURES[name], transforms, **coding)) == PICTURES[name]).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
@pytest.mark.parametrize("coding", [{}, {"refs": True, "cache_bits": 2}])
def test_palettes(colours, coding):
    own = RNG.integers(0, 256, (colours, 4), dtype=np.uint8)
    picture = own[RNG.integers(0, colours, (11, 37))]
    assert (webp.decode(webp.encode(picture, ("palette",), **coding)) == picture).all()


@pytest.mark.parametrize("size", [1, 2, 3, 40_000, 2_000_003])
def test_payloads(size):
    raw = bytes(random.Random(size).choices(b"etaoin shrdlu\n\xc3\xa9", k=size))
    raw += b"\xff" * (-len(raw) % 576)
    files = media.store_many([raw, b"\xff" * 576, raw])
    assert media.load_many(files) == [raw, b"\xff" * 576, raw] and files[0] == files[2] == media.store_many([raw])[0]


def _strips():
    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:8, 0:192]
    ramp = np.stack([x + 3 * y, 2 * x, x], -1).astype(np.uint8)
    columns = np.tile(rng.integers(0, 256, (1, 192, 3), dtype=np.uint8), (8, 1, 1))
    grey = rng.integers(0, 256, (8, 192, 1), dtype=np.uint8).repeat(3, 2)
    text = np.frombuffer((b"to be or not to be, that is the question. " * 200)[:4608], np.uint8).reshape(8, 192, 3)
    words = np.frombuffer(b" ".join(random.Random(3).choices([b"the", b"of", b"and", b"a", b"to", b"in", b"ring"], k=2000))[:4608], np.uint8).reshape(8, 192, 3)
    noise = rng.integers(0, 256, (8, 192, 3), dtype=np.uint8)
    flat = np.full((3, 192, 3), 255, np.uint8)
    skewed = np.minimum(rng.geometric(0.02, (8, 192, 3)), 255).astype(np.uint8)
    return {"ramp": ramp, "columns": columns, "grey": grey, "text": text, "words": words, "noise": noise, "flat": flat, "skewed": skewed, "one row": noise[:1], "dark": np.zeros((1, 192, 3), np.uint8)}


def test_batch_against_the_plain_codec():
    """What the batch writes reads the same by the batch and by the plain reader, and takes the parts that pay."""
    strips = _strips()
    files = webp_batch.encode_many(list(strips.values()))
    for name, file, found in zip(strips, files, webp_batch.decode_many(files), strict=True):
        for got in (found, webp.decode(file)):
            assert (got[..., :3] == strips[name]).all() and (got[..., 3] == 255).all(), name
    assert [webp_batch.encode_many([s])[0] for s in strips.values()] == files  # a picture's file doesn't depend on its company
    heads = dict(zip(strips, map(webp_batch._head, files), strict=True))
    assert heads["grey"][2] == webp_batch.GREEN and heads["columns"][2] == webp_batch.TOP and heads["ramp"][2] == webp_batch.LEFT and heads["words"][2] == webp_batch.PLAIN
    assert heads["words"][3] == 8 and heads["noise"][3] == 0  # a colour cache where it pays
    assert len(files[list(strips).index("text")]) < 300  # a copy


@pytest.mark.parametrize("transforms", [(), ("subtract_green",), ("predictor",), ("cross_color",)])
@pytest.mark.parametrize("coding", [{}, {"refs": True}, {"cache_bits": 4}, {"refs": True, "cache_bits": 10}, {"meta_bits": 2}])
def test_batch_reads_the_plain_writer(transforms, coding):
    files = [webp.encode(p, transforms, **coding) for p in PICTURES.values()]
    for picture, got in zip(PICTURES.values(), webp_batch.decode_many(files), strict=True):
        assert (got == picture).all()


def test_a_file_of_another_writer():
    """A picture of one pixel that is widely used to ask browsers for lossless WebP, made by the format's own tools."""
    file = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    for got in (webp.decode(file), webp_batch.decode_many([file])[0]):
        assert got.shape == (1, 1, 4) and got[0, 0, 3] == 0


def test_huffman_lengths_in_step():
    rng = np.random.default_rng(4)
    counts = np.where(rng.random((40, 60)) < 0.5, 0, rng.integers(1, 2000, (40, 60)))
    counts[0], counts[1], counts[2, :] = 0, 0, 2 ** np.minimum(np.arange(60), 40)
    counts[1, 7] = 3
    lens = webp_batch.code_lengths(counts, 12)
    for c, found in zip(counts, lens, strict=True):
        assert ((found > 0) == (c > 0)).all() and found.max() <= 12
        if (c > 0).sum() > 1:
            assert (2.0 ** -found[found > 0]).sum() == 1
        plain = webp.code_lengths(c, 12)
        if plain.max() < 12:  # no limit in the way: as short as can be
            assert (c * found).sum() == (c * plain).sum()
    assert (webp_batch.canonical(lens) == np.array([webp.canonical(row) for row in lens])).all()


def test_feature_by_hand():
    samples = np.frombuffer(random.Random(1).randbytes(576 * 3), np.uint8)
    mean = sum(samples.tolist()) / len(samples)
    bits = ["1" if sum(int(samples[r * 576 + c * 9 + k]) for r in range(3) for k in range(9)) / 27 > mean else "0" for c in range(64)]
    assert media.feature(samples) == f"{int(sum(samples.tolist()) * 1000 // len(samples))}:{int(''.join(bits), 2):016x}"


def test_pixels_of_a_column(spark):
    files = [(1, webp.encode(PICTURES["noise"], ())), (2, None), (3, b"RIFF"), (4, webp.encode(PICTURES["flat"], ("palette",)))]
    df = spark.createDataFrame([(k, bytearray(f) if f is not None else None) for k, f in files], "id long, media binary").withColumn("height", F.lit("kept"))
    got = {r["id"]: r for r in media.pixels(df).collect()}
    assert bytes(got[1]["__pixels"]) == PICTURES["noise"].tobytes() and (got[1]["__height"], got[1]["__width"]) == (13, 21)
    assert got[2]["__pixels"] is None and got[2]["__error"] is None and got[3]["__error"] and bytes(got[4]["__pixels"]) == PICTURES["flat"].tobytes()
    assert {r["height"] for r in got.values()} == {"kept"} and media.pixels(df.limit(0)).count() == 0


def test_broken_files_are_refused():
    whole = webp.encode(PICTURES["noise"], ())
    for bad in (b"", b"RIFF", whole[:40], whole[:-60]):
        for read in (webp.decode, lambda f: webp_batch.decode_many([f])):
            with pytest.raises((ValueError, IndexError)):
                read(bad)


def test_digests(spark):
    texts = {1: "abc", 2: None, 3: "", 4: "é" * 5000, 5: "x" * 576, 6: "word " * 300_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = {r["id"]: r for r in media.media_digests(df, keep_media=True).collect()}
    for i, text in texts.items():
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert media.load_many([bytes(r["media"])]) == [payload] and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    assert got[2]["feature"] == got[3]["feature"]
    assert media.media_digests(df.limit(0)).count() == 0


EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def test_fold(spark):
    log = [
        (1, 1, 0, "start", "user", None), (1, 1, 1, "delta", None, "Hel"), (1, 1, 2, "delta", None, "lo"),
        (1, 2, 3, "start", "assistant", None), (1, 2, 4, "delta", None, "bad"), (1, 1, 5, "edit", None, "Hi"), (1, 2, 6, "regenerate", None, None),
        (1, 2, 7, "delta", None, "go"), (1, 2, 8, "delta", None, "od"), (1, 2, 8, "delta", None, "od"), (1, 3, 9, "start", "user", None), (1, 3, 10, "delete", None, None),
        (1, 1, 11, "delta", None, "!"), (None, 1, 0, "start", None, None), (None, 1, 1, "delta", None, "x"), (2, 1, 5, "delta", None, "orphan"), (2, 9, 6, "odd", None, "?"),
    ]
    got = sorted(((r["conv_id"], r["position"], r["role"], r["text"]) for r in chat_events.fold_events(spark.createDataFrame(log, EVENTS)).collect()), key=str)
    assert got == sorted([(1, 0, "user", "Hi!"), (1, 3, "assistant", "good"), (None, 0, "", "x"), (2, 5, "", "orphan"), (2, 6, "", "")], key=str)


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "\\l<s>", "<|x|>\n", "<<s>", "[[INST]", "", "a\nb", "<s", "\\\\b[/INST]<|"])
def test_escapes_are_reversible(spark, text):
    rows = spark.createDataFrame([(1, 0, text, text)], "conv_id long, position long, role string, text string")
    turn = chat_events.render(rows).first()
    assert chat_events.parse(turn["turn"])[:2] == (text, text)
    body = turn["turn"][len(chat_events.OPEN) : -len(chat_events.END)]
    assert not any(c in body for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|")) and body.count("|>\n") == 1


def test_formatted_conversations(spark):
    rng = random.Random(1)
    parts = ["</s>", "[INST]", "\\", "word ", "é", "<|", "\n", "<s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "".join(rng.choices(parts, k=400))])) for c in [*range(20), None] for t in range(rng.randint(1, 7))]
    rows += [(50, 0, "user", "same"), (50, 0, "user", "same"), (50, 0, "assistant", "tie"), (51, 0, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_events.digest(chat_events.render(chat_events.fold_events(chat_events.as_events(df)))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat_events.digest(chat_events.render(chat_events.fold_events(chat_events.as_events(df.limit(0))))).count() == 0


def test_query_has_the_probe(spark):
    got = {r["conv_id"]: r for r in chat_events.op9_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(text) and got[-1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
