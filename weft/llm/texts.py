"""What the text operators share: folds, bounded samples of labelled rows, batch limits."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import suppress
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:  # workers that only handle Arrow batches don't load pandas
    import pandas as pd


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out(id_col: str = "doc_id") -> Column:
    """True where the fold is 2: labels of these rows are never learnt. False for a null id, which isn't learnt either."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def portions(batches, rows: int = 1000, mb: int = 16):
    """Arrow batches cut to at most `rows` rows and, down to one row, `mb` MB: what one call of an operator holds."""
    for batch in batches:
        todo = [batch.slice(k, rows) for k in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > mb << 20:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def give_back() -> None:
    """Return what a task has freed to the system. Python workers live on from task to task and would keep their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def learnt_part(text: str, key: str, most: int, seed: int) -> Column:
    """What is learnt of a text: all of it, or of one over `most` code points a stretch of so many at a place that the key's hash picks."""
    spare = F.char_length(text) - most
    return F.when(spare <= 0, F.col(text)).otherwise(F.substring(F.col(text), (F.pmod(F.xxhash64(key, F.lit(seed + 1)), spare + 1) + 1).cast("int"), F.lit(most)))


def labelled_sample(
    docs: DataFrame, label_col: str, id_col: str, text_col: str, per_label_bytes: int, max_doc_chars: int, seed: int
) -> pd.DataFrame:
    """Rows (label, text) of a seeded sample of rows outside fold 2.

    Each label value gives about `per_label_bytes` of texts; of a text over
    `max_doc_chars` a stretch of so many is learnt. One sum a label is collected,
    then the sample, so what the driver holds grows with the number of labels.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    usable = usable.where((fold("id") != 2) & F.col("label").isNotNull() & F.col("text").isNotNull()).withColumn("text", learnt_part("text", "id", max_doc_chars, seed))
    shares = usable.groupBy("label").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    limit = F.lit(-1)
    for row in shares:
        share = min(1.0, per_label_bytes / max(1, row["n"]))
        limit = F.when(F.col("label") == F.lit(row["label"]), int(share * (1 << 30))).otherwise(limit)
    picked = usable.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < limit)
    return picked.toPandas().sort_values(["label", "id", "text"], kind="stable", ignore_index=True)[["label", "text"]]


def sample_of_labels(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_label: int, max_doc_chars: int, seed: int
) -> pd.DataFrame:
    """Rows (label, text) of a seeded sample of labels 0 and 1 outside fold 2.

    About `per_label` documents of each label are picked from the labels alone;
    their ids, no more than that, are broadcast to fetch the texts in one scan.
    Of a text over `max_doc_chars` a stretch of so many is learnt. Null labels,
    ids and texts don't count; a document labelled alike twice counts once, one
    labelled both ways is there with either label.
    """
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)").where(fold("__id") != 2).distinct()
    limit = F.lit(-1)
    for row in usable.groupBy("__label").count().collect():
        limit = F.when(F.col("__label") == row["__label"], int(min(1.0, per_label / row["count"]) * (1 << 30))).otherwise(limit)
    ids = usable.where(F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 30)) < limit)
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).where("text is not null")
    picked = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).select("__id", F.col("__label").alias("label"), learnt_part("text", "__id", max_doc_chars, seed).alias("text")).distinct()
    return picked.toPandas().sort_values(["label", "__id", "text"], kind="stable", ignore_index=True)[["label", "text"]]


def append(df: DataFrame, keep: list[str], make: Callable, new: dict[str, tuple[str, pa.DataType]], rows: int = 1000, mb: int = 16) -> DataFrame:
    """`keep` columns of df, untouched, and `new` ones (name: its SQL and Arrow types) from a function of Arrow batches.

    make() is called once a task; what it returns maps a batch of at most `rows`
    rows and about `mb` MB to a dict of columns. Kept columns never pass through
    pandas, so nulls and large integers stay as they are.
    """

    def run(batches):
        columns = make()
        for batch in portions(batches, rows, mb):
            found = columns(batch)
            arrays = [batch.column(c) for c in keep] + [pa.array(found[c], type=kind, from_pandas=True) for c, (_, kind) in new.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])
            del batch, found, arrays
        give_back()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep] + [f"`{c}` {kind}" for c, (kind, _) in new.items()]
    order = {c: k for k, c in enumerate(keep)}
    kinds[: len(keep)] = sorted(kinds[: len(keep)], key=lambda k: order[k[1:].split("`")[0]])
    return df.mapInArrow(run, ", ".join(kinds))


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column with null texts as empty ones."""
    return [t or "" for t in batch.column(column).to_pylist()]
