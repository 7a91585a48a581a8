"""Edge-list files in, pair files out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.labels import LabelFormat, classify, paired


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows (src, dst, label, index) of a text file with one edge a line: source, target, label and, unless `normal`, an id.

    Blank lines and lines without two numbers and a label go. A missing file
    raises what Spark raises when the rows are read.
    """
    return _split(spark.read.text(path))


def _split(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim(F.col("value")), r"\s+")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    rows = lines.select(at(1).try_cast("long").alias("src"), at(2).try_cast("long").alias("dst"), at(3).alias("label"), at(4).try_cast("long").alias("index"))
    return rows.where("src is not null and dst is not null and label is not null")


def read_edges(spark: SparkSession, path: str, format: LabelFormat = LabelFormat()) -> DataFrame:
    """The graph of a file: classified edges, without labels that lack a half."""
    return paired(classify(read_raw(spark, path), format))


def pair_lines(pairs: DataFrame) -> DataFrame:
    """One text column: a tab, source, blank, target."""
    return pairs.orderBy("src", "dst").select(F.format_string("\t%d %d", "src", "dst").alias("value"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs as text files under `path`."""
    pair_lines(pairs).write.mode("overwrite").text(path)


def output_path(graph_path: str, directory: str | None = None) -> str:
    """<directory>/<file name without its last extension>.out; the directory, by default `output`, is made if it isn't there."""
    base = os.path.basename(graph_path)
    stem, dot, _ = base.rpartition(".")
    directory = directory or "output"
    os.makedirs(directory, exist_ok=True)
    return os.path.join(directory, f"{stem if dot else base}.out")
