"""The tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: family: p (parentheses), b (brackets) or n (normal); side: o (opens), c (closes) or n. label is 0 for normal edges.
EDGES = T.StructType([
    T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("family", T.StringType()),
    T.StructField("side", T.StringType()), T.StructField("label", T.LongType()),
])
PAIRS = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
