"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import materialise

_SALTS = 64  # a length of a hot source is dealt to so many groups


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_limit: int = 1 << 20) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to `budget`, or as near below as found.

    `counts` documents of each size are there. A proportional draw with carried
    rounding comes within about the largest size of the budget; some of it is
    given back, so that about eight of the largest sizes are open. They are a
    bounded knapsack, solved by dynamic programming over the reachable sums.
    Where more than `dp_limit` is open (documents of many thousands of words),
    the largest documents that fit come first until it isn't.
    """
    order = np.argsort(sizes)
    sizes, counts = np.asarray(sizes, np.int64)[order], np.asarray(counts, np.int64)[order]
    whole = int((sizes * counts).sum())
    budget = max(0, min(int(budget), whole))
    taken = np.zeros(len(sizes), np.int64)
    if whole:
        mark = np.floor(budget / whole * np.cumsum(counts) + 0.5).astype(np.int64)
        taken = np.clip(np.diff(mark, prepend=0), 0, counts)
    left = budget - int((taken * sizes).sum())
    # give back some of the largest, at least while over the budget: room for the dynamic programme to choose anew
    room, spread = min(8 * int(sizes.max(initial=0)), dp_limit), max(1, int(taken.max(initial=0)) // 8)
    for part, want, widest in ((spread, room, room), (int(taken.max(initial=0)), room, room), (int(taken.max(initial=0)), 0, int(sizes.max(initial=0)))):
        for k in range(len(sizes) - 1, -1, -1):
            if left < want and 0 < sizes[k] <= widest:
                back = min(int(taken[k]), part, -(-(want - left) // int(sizes[k])))
                taken[k] -= back
                left += back * int(sizes[k])
    for k in range(len(sizes) - 1, -1, -1):
        if left <= dp_limit:
            break
        if sizes[k]:
            more = min(int(counts[k] - taken[k]), (left - dp_limit) // int(sizes[k]) + 1, left // int(sizes[k]))
            taken[k] += more
            left -= more * int(sizes[k])
    # bounded knapsack: bit s of `reach` says that s can be made of the pieces so far
    reach, full, steps = 1, (1 << (left + 1)) - 1, []
    for k in np.flatnonzero((sizes > 0) & (counts > taken) & (sizes <= left))[::-1]:
        spare, power = min(int(counts[k] - taken[k]), left // int(sizes[k])), 1
        while spare and not reach >> left & 1:
            part = min(power, spare)
            steps.append((int(k), part, reach))
            reach |= reach << part * int(sizes[k]) & full
            spare, power = spare - part, power * 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for k, part, before in reversed(steps):
        if not before >> at & 1:
            taken[k] += part
            at -= part * int(sizes[k])
    out = np.zeros(len(sizes), np.int64)
    out[order] = taken
    return out


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds `weight` and `target` to rows (absent, source, total): one row per source.

    Weights repeat over the sources by code point, null last. The targets share
    `share` of all sizes by weight; none exceeds `most` times its source's size,
    the excess goes to the others by weight until none is above. Sources in
    order of size per weight are capped one after another, so the level is found
    with running sums over one row per source.
    """
    place = F.row_number().over(Window.orderBy("absent", "source")) - 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("total")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "absent", "source")
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ranked.select(
        "*", (F.sum("total").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("pool"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open"),
    )
    # the first source that isn't capped sets the level
    free = level.withColumn("free", F.col("pool") * F.col("weight") / F.col("open") <= F.col("cap"))
    first = free.withColumn("n", F.row_number().over(by)).withColumn("cut", F.min(F.when(F.col("free"), F.col("n"))).over(everything))
    at = lambda c: F.max(F.when(F.col("n") == F.col("cut"), F.col(c))).over(everything)
    return first.withColumn("P", at("pool")).withColumn("O", at("open")).select(
        "absent", "source", "total", F.when((F.col("n") < F.col("cut")) | F.col("cut").isNull(), F.col("cap")).otherwise(F.col("P") * F.col("weight") / F.col("O")).alias("target"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, dp_limit: int = 1 << 20, seed: int = 29,
) -> DataFrame:
    """The rows of `docs` with __size, __source_size, __target and __copies: how often the mix takes each.

    A size is the number of runs of characters other than ASCII blanks; a null
    text has 0. Every source is taken whole floor(target / its size) times; the
    rest of its target is a subset-sum over its counts of documents by size
    (`fit_counts`), and among documents of one size those with the least seeded
    hash are taken. Documents of a size are ranked in 64 groups by hash, so a
    hot source or a length shared by a third of all rows stays spread. Rows that
    share an id rank in any order but are alike; null ids and null sources are
    values like others. A source of empty texts has target 0. An empty table
    gives no rows. Columns of `docs` come back as they are; names that begin
    with two underscores are reserved. `dp_limit` is what the dynamic programme
    may leave open, in words (see `fit_counts`): its bit sets take that many bits.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_col))
    rows = docs.select(
        "*", F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("__size"),
        F.coalesce(F.col(source_col), F.lit("")).alias("__source"), F.col(source_col).isNull().alias("__absent"),
        key.alias("__key"), F.pmod(key, F.lit(_SALTS)).cast("int").alias("__salt"),
    )
    group = ["__absent", "__source", "__size"]
    salted = materialise(rows.groupBy(*group, "__salt").agg(F.count("*").alias("__n")))
    by_size = salted.groupBy(*group).agg(F.sum("__n").alias("__n"))
    sources = by_size.groupBy("__absent", "__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("total"))
    aims = materialise(targets(sources.withColumnsRenamed({"__absent": "absent", "__source": "source"}), weights, share, most))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        total, target = int(part["__total"].iloc[0]), float(part["__target"].iloc[0])
        rounds = min(most, int(target // total)) if total else 0
        rest = fit_counts(part["__size"].to_numpy(), part["__n"].to_numpy(), int(round(target - rounds * total)) if rounds < most else 0, dp_limit)
        return part[[*group, "__total", "__target"]].assign(__rounds=rounds, __quota=rest)

    aimed = by_size.join(aims.withColumnsRenamed({"absent": "__absent", "source": "__source", "total": "__total", "target": "__target"}), ["__absent", "__source"])
    kinds = "__absent boolean, __source string, __size long, __total long, __target double, __rounds int, __quota long"
    fitted = materialise(aimed.groupBy("__absent", "__source").applyInPandas(fit, kinds))
    # the quota of a size goes to its groups in order
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quotas = salted.withColumn("__before", before).join(fitted, group).select(*group, "__salt", "__total", "__target", "__rounds", (F.col("__quota") - F.col("__before")).alias("__own"))
    rank = F.row_number().over(Window.partitionBy(*group, "__salt").orderBy("__key", F.col(f"`{id_col}`")))
    chosen = rows.join(quotas, [*group, "__salt"]).withColumn("__rank", rank)
    return chosen.select(
        *[F.col(f"`{c}`") for c in docs.columns], "__size", F.col("__total").alias("__source_size"), "__target",
        (F.col("__rounds") + F.when(F.col("__rank") <= F.col("__own"), 1).otherwise(0)).alias("__copies"),
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it."""
    mixed = mix(docs, **options).where("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    """All `documents` with what a 3:1:2 mix of 150 % of their words takes of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )
