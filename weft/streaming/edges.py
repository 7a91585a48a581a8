"""Edge files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.functions.labels import LabelFormat, classify
from weft.sources.edge_list import _split


def stream_edges(spark: SparkSession, folder: str, format: LabelFormat = LabelFormat()) -> DataFrame:
    """Classified edges of the files that appear in a folder, as a stream; each batch holds an edge once.

    Labels that lack a half can't be told before the end: apply `paired` to the
    table that the stream fills, which `append_edges` keeps free of repeats.
    """
    lines = spark.readStream.schema("value string").text(folder)
    return classify(_split(lines), format)


def append_edges(stream: DataFrame, table: str, checkpoint: str):
    """Start a query that appends edges to a Parquet table; repeats go by the stream's state."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
