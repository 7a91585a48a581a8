"""Prefix scans over keys of any size: hot keys are cut into slices of their order, slices into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialise


def sliced(rows: DataFrame, keys: list[str], at: str, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """`rows` with columns `slice`, which rises with the long column `at` within the keys, and `hot`, and the keys that have several slices (hot).

    Keys of at most `slice_rows` rows have slice 0 alone. Others are cut into
    equal lengths of `at`, four times as many as rows ask for, so that a key
    denser at some times than at others still gives slices of bounded size.
    Both frames are written. The second (keys, key_rows, key_lo, key_hi, key_parts) has a row for `slice_rows` rows
    at most; Spark broadcasts it only below its own limit.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"), F.min(at).alias("key_lo"), F.max(at).alias("key_hi"))
    heavy = materialise(counted.where(F.col("key_rows") > slice_rows).withColumn("key_parts", F.ceil(F.col("key_rows") / slice_rows) * 4))
    width = (F.col("key_hi") - F.col("key_lo") + 1) / F.col("key_parts")
    place = F.least(F.floor((F.col(at) - F.col("key_lo")) / width), F.col("key_parts") - 1)
    out = rows.join(heavy, keys, "left").withColumn("slice", F.coalesce(place, F.lit(0)).cast("long"))
    return materialise(out.select(*rows.columns, "slice", F.col("key_parts").isNotNull().alias("hot"))), heavy


def carried(totals: DataFrame, keys: list[str], order: str, sums: list[str] = (), maxes: list[str] = (), block: int = 1024) -> DataFrame:
    """For each row of `totals` what the rows before it within the keys add up to, in the same columns.

    `order` is a long column, unique within the keys. Rows are scanned within
    blocks of `block` values of it and then blocks among each other, so no task
    sees more of a key than a block's rows or its blocks. Before the first row
    a sum is 0 and a maximum null; nulls are passed over.
    """
    both = [*[(c, F.sum) for c in sums], *[(c, F.max) for c in maxes]]
    blocks = totals.groupBy(*keys, F.floor(F.col(order) / block).alias("block")).agg(*[f(c).alias(c) for c, f in both])
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block", *[f(c).over(earlier).alias(f"{c}_block") for c, f in both])
    within = Window.partitionBy(*keys, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.withColumn("block", F.floor(F.col(order) / block)).select(*keys, order, "block", *[f(c).over(within).alias(c) for c, f in both])

    def joined(c: str, f) -> Column:
        a, b = F.col(c), F.col(f"{c}_block")
        return (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if f is F.sum else F.greatest(a, b)).alias(c)

    return rows.join(blocks, [*keys, "block"]).select(*keys, order, *[joined(c, f) for c, f in both])
