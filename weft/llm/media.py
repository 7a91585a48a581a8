"""Media columns: payloads as lossless WebP pictures, and pictures as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.lossless_webp import decode
from weft.llm.texts import append, strings
from weft.llm.webp_batch import decode_many, encode_many

_UNIT = 576
_ROWS = 8  # of a picture: a longer payload takes several, which are read side by side


def store_many(payloads: list[bytes], row: int = _UNIT) -> list[bytes]:
    """Each payload as red, green and blue samples of lossless WebP files, one file after another.

    Lengths are positive multiples of `row`, itself a multiple of 3: a row of a
    picture holds `row` samples, a picture 8 rows at the most.
    """
    strips, owner = [], []
    for k, payload in enumerate(payloads):
        samples = np.frombuffer(payload, np.uint8)
        for at in range(0, len(samples), _ROWS * row):
            strips.append(samples[at : at + _ROWS * row].reshape(-1, row // 3, 3))
            owner.append(k)
    out: list[list[bytes]] = [[] for _ in payloads]
    for k, file in zip(owner, encode_many(strips), strict=True):
        out[k].append(file)
    return [b"".join(files) for files in out]


def load_many(media: list[bytes]) -> list[bytes]:
    """The bytes behind `store_many`."""
    files, owner = [], []
    for k, blob in enumerate(media):
        at = 0
        while at < len(blob):
            size = 8 + int.from_bytes(blob[at + 4 : at + 8], "little")
            files.append(blob[at : at + size])
            owner.append(k)
            at += size
    out: list[list[bytes]] = [[] for _ in media]
    for k, pixels in zip(owner, decode_many(files), strict=True):
        out[k].append(np.ascontiguousarray(pixels[:, :, :3]).tobytes())
    return [b"".join(parts) for parts in out]


def feature(samples: np.ndarray, row: int = _UNIT) -> str:
    """Mean of the samples in thousandths, and 64 bits: which of 64 columns of the picture are lighter than it."""
    columns = samples.reshape(-1, 64, row // 64).sum(axis=(0, 2), dtype=np.int64)
    total = int(columns.sum())
    bits = columns * 64 > total
    return f"{total * 1000 // len(samples)}:{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Rows (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media]).

    Every whole text, a null one as empty, is padded with bytes 255 to a
    positive multiple of 576, stored as lossless WebP and read back; digests and
    feature come from what was read. Long texts take several files. Equal texts
    of a batch are stored once. Other columns are ignored; repeated rows give
    repeated results.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]

    def convert(batch):
        texts = [t.encode() for t in strings(batch, "text")]
        own = list(dict.fromkeys(texts))
        media = store_many([raw + b"\xff" * (-len(raw) % _UNIT or (0 if raw else _UNIT)) for raw in own])
        rows = {}
        for raw, blob, back in zip(own, media, load_many(media), strict=True):
            rows[raw] = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(np.frombuffer(back, np.uint8)), blob if keep_media else None)
        return dict(zip(names, zip(*[rows[raw] for raw in texts], strict=True), strict=True)) if texts else {c: [] for c in names}

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    sql = ["long", "long", "string", "long", "long", "string", "string", "binary"]
    new = {c: (k, kinds[k]) for c, k in list(zip(names, sql, strict=True))[: 8 if keep_media else 7]}
    return append(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], lambda: convert, new, rows=1000, mb=4)


def pixels(table: DataFrame, media_col: str = "media") -> DataFrame:
    """`table` with __height, __width, __pixels (rows of red, green, blue, alpha) and __error of a column of lossless WebP files.

    A null file gives nulls; one that can't be read gives nulls and says why in
    __error. All other columns come back as they are.
    """

    def one(file: bytes) -> tuple:
        try:
            found = decode(file)
        except (ValueError, IndexError) as e:
            return None, None, None, str(e) or "the file is cut off"
        return found.shape[0], found.shape[1], found.tobytes(), None

    def read(batch):
        files = batch.column(media_col).to_pylist()
        at = [k for k, f in enumerate(files) if f is not None]
        rows: list[tuple] = [(None,) * 4] * len(files)
        try:
            own = [(p.shape[0], p.shape[1], p.tobytes(), None) for p in decode_many([files[k] for k in at])]
        except (ValueError, IndexError):  # some file is broken: each by itself
            own = [one(files[k]) for k in at]
        for k, row in zip(at, own, strict=True):
            rows[k] = row
        return dict(zip(["__height", "__width", "__pixels", "__error"], zip(*rows, strict=True) if rows else [()] * 4, strict=True))

    new = {"__height": ("int", pa.int32()), "__width": ("int", pa.int32()), "__pixels": ("binary", pa.binary()), "__error": ("string", pa.string())}
    return append(table, table.columns, lambda: read, new, rows=64, mb=8)


def op8_media(spark, sf_dir: str) -> DataFrame:
    """All whole texts of `documents` through lossless WebP and back."""
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
