"""Label classes, halves, ranks and masks as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.languages import Language, mask_column


def default_family(label: Column) -> Column:
    """p or b by the second character, n for `normal`, else null."""
    second = F.substring(label, 2, 1)
    return F.when(second == "p", "p").when(second == "b", "b").when(label == "normal", "n")


def default_side(label: Column) -> Column:
    """c if the first character is c, else o: whatever doesn't close opens."""
    return F.when(label == "normal", "n").when(F.substring(label, 1, 1) == "c", "c").otherwise("o")


@dataclass(frozen=True)
class LabelFormat:
    """How label names are read: two functions of a label column. Rows with a null family are dropped."""

    family: Callable[[Column], Column] = default_family
    side: Callable[[Column], Column] = default_side


def classify(raw: DataFrame, format: LabelFormat = LabelFormat(), *within: str) -> DataFrame:
    """Edges (src, dst, family, side, label) of rows (src, dst, label, index), each once; unknown labels go.

    `within` further columns are kept, and edges are told apart by them too: no
    shuffle where rows are dealt by them already.
    """
    label = F.col("label")
    out = raw.select(*within, "src", "dst", format.family(label).alias("family"), format.side(label).alias("side"), F.col("index").cast("long").alias("index"))
    out = out.where("family is not null and src is not null and dst is not null")
    return out.select(*within, "src", "dst", "family", "side", F.when(F.col("family") == "n", 0).otherwise(F.col("index")).cast("long").alias("label")).where("label is not null").dropDuplicates()


def paired(edges: DataFrame, *within: str, few: bool = False) -> DataFrame:
    """Edges without the labels that lack an opening or a closing half; `within` further columns, such as a component.

    `few` labels, a handful by their making, are sent to where the edges are,
    which stay in their order.
    """
    keys = [*within, "family", "label"]
    halves = edges.where("family <> 'n'").groupBy(*keys).agg(F.max(F.col("side") == "o").alias("o"), F.max(F.col("side") == "c").alias("c")).where("o and c")
    if few:
        return edges.join(F.broadcast(halves.select(*keys, F.lit(True).alias("__both"))), keys, "left").where("family = 'n' or __both").select(edges.columns)
    kept = edges.where("family <> 'n'").join(halves.select(*keys), keys, "left_semi")
    return kept.select(edges.columns).union(edges.where("family = 'n'"))


def ranked(edges: DataFrame, *within: str) -> DataFrame:
    """Adds `rank`: the place of a label among those of its family that are there, from 0; 0 for normal edges.

    One row per label is ranked, then joined back, so a frequent label costs no
    sort of its edges.
    """
    keys = [*within, "family", "label"]
    order = edges.where("family <> 'n'").select(*keys).distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*within, "family").orderBy("label")) - 1)
    return edges.join(order, keys, "left").select(*edges.columns, F.coalesce("rank", F.lit(0)).alias("rank"))


def masked(edges: DataFrame, language: Language, *within: str) -> DataFrame:
    """Adds `rank` and `mask`: the group bit that an edge of the counted family flips under a language, else 0."""
    bit = F.when(F.col("family") == F.lit(language.counted), mask_column(language, F.col("rank"))).otherwise(0)
    return ranked(edges, *within).withColumn("mask", bit.cast("int" if language.k < 32 else "long"))
