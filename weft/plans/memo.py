"""Memo of components: those of one shape are solved once.

The shape of a component is the sorted list of its edges, vertices and labels
numbered in the order of their ids. No analysis looks at more than that order,
so components of one shape have one result, up to the numbers. Equal components
whose ids come in another order aren't recognised, and solved by themselves.

Shapes are made by array functions in one shuffle by component; a component is
one row, so this is for components that a task can hold. What is solved is one
row a shape, dealt over tasks however few bytes these are.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialise

#: Parts that the components of one shape are dealt over when they take its result, as one shape may hold most of them.
SALTS = 16


def _number(values: Column, value: Column) -> Column:
    return F.array_position(values, value)


def shapes(parts: DataFrame) -> DataFrame:
    """Of each component: comp, vertices (ids in order), shape (text of the numbered edges) and its digest; parts: edges with `comp`.

    Repeated edges count once; other columns are ignored. No edges, no rows.
    """
    edge = F.struct("src", "dst", "family", "side", "label")
    sets = parts.groupBy("comp").agg(F.array_sort(F.collect_set(edge)).alias("edges"))
    ends = F.concat(F.transform("edges", lambda e: e["src"]), F.transform("edges", lambda e: e["dst"]))
    name = lambda e: F.struct(e["family"].alias("family"), e["label"].alias("label"))
    listed = sets.select("comp", "edges", F.array_sort(F.array_distinct(ends)).alias("vertices"), F.array_sort(F.array_distinct(F.transform("edges", name))).alias("names"))
    # numbers keep the order of ids, so the list stays sorted
    text = F.transform(
        "edges", lambda e: F.concat_ws(",", _number(F.col("vertices"), e["src"]), _number(F.col("vertices"), e["dst"]), e["family"], e["side"], _number(F.col("names"), name(e)))
    )
    return listed.select("comp", "vertices", F.array_join(text, ";").alias("shape")).withColumn("digest", F.sha2("shape", 256))


def _edges(shape: str) -> set[tuple[int, int, str, str, int]]:
    rows = (e.split(",") for e in shape.split(";"))
    return {(int(u), int(v), family, side, int(label)) for u, v, family, side, label in rows}


def once(parts: DataFrame, run: Callable[[set], list[tuple[int, int]]]) -> DataFrame:
    """The pairs that `run` makes of the edges of each component, run on one component of each shape."""
    shaped = materialise(shapes(parts))
    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("comp"), F.lit(SALTS)).cast("int")
    # a result goes to the salts that its members have: one copy for a shape that comes once
    different = shaped.groupBy("digest", "shape").agg(F.collect_set(salt).alias("salts")).repartition(spread, "digest")

    def solve(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                own = batch.slice(at, 1_000)
                found = [run(_edges(shape)) for shape in own["shape"].to_pylist()]
                ends = [pa.array([[p[k] for p in pairs] for pairs in found], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([own["digest"], own["salts"], *ends], names=["digest", "salts", "starts", "ends"])

    solved = materialise(different.mapInArrow(solve, "digest string, salts array<int>, starts array<int>, ends array<int>"))
    salted = solved.withColumn("salt", F.explode("salts"))
    members = shaped.select("vertices", "digest", salt.alias("salt"))
    id_of = lambda number: F.element_at(F.col("vertices"), number)
    pairs = F.zip_with("starts", "ends", lambda a, b: F.struct(id_of(a).alias("src"), id_of(b).alias("dst")))
    return members.join(salted, ["digest", "salt"]).select(F.inline(pairs))
