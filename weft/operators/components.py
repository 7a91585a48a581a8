"""Connected components: what a task sees is united there, what meets across tasks by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import materialise, release

#: Edges that a task unites at once.
CHUNK = 1 << 20


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first())


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All vertices, the least vertex of the component of each, and of each edge, by least labels and pointer jumping."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        for at in (root[u], root[v], u, v):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return names, names[root], names[root[u]]


def _in_one_task(batches):
    """Components of all edges of one partition."""
    parts = [np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches if b.num_rows]
    if not parts:
        return
    names, root, _ = _roots(*np.concatenate(parts, axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(root)], names=["vertex", "component"])


def united(edges: DataFrame, src: str = "src", dst: str = "dst", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(edges with `root`, (root, component)): components without a row for each vertex or a join by vertices.

    root is the smallest vertex that up to `chunk` edges which lie together
    connect with an edge's ends; the second table has the smallest vertex of the
    whole component for those roots whose component other edges reach too. Ends
    are long. Edges with a null end are dropped. Where the edges of a component
    lie together, as those made by a window do, few roots are left to unite:
    rows by vertex are shuffled once, and the rounds of `connected_components`
    run over the roots alone.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema) + ", root long"

    def tag(batches):
        own, n = [], 0

        def flush():
            table = pa.Table.from_batches(own).combine_chunks()
            root = _roots(table[src].to_numpy(), table[dst].to_numpy())[2]
            yield from table.append_column("root", pa.array(root.astype(np.int64))).to_batches(max_chunksize=1 << 16)

        for batch in batches:
            if batch.num_rows:
                own.append(batch)
                n += batch.num_rows
            if n >= chunk:
                yield from flush()
                own, n = [], 0
        if own:
            yield from flush()

    tagged = materialise(edges.where(f"`{src}` is not null and `{dst}` is not null").mapInArrow(tag, schema))
    ends = tagged.select(F.col(src).alias("vertex"), "root").union(tagged.select(F.col(dst).alias("vertex"), "root"))
    split = ends.groupBy("vertex").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    split = materialise(split.select("vertex", "low"))
    if split.isEmpty():
        return tagged, tagged.select("root", F.col("root").alias("component")).limit(0)
    links = ends.join(split, "vertex").where("root > low").select("root", "low").distinct()
    found = materialise(connected_components(links, "root", "low", one_task=CHUNK))
    return tagged, found.select(F.col("vertex").alias("root"), "component")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task: int = 0) -> DataFrame:
    """Rows (vertex, component) for every vertex of an undirected edge table.

    component is the smallest vertex of the component. Self-loops make a vertex
    of their own; null ends are ignored; repeated edges count once. Each round
    hangs vertices onto smaller neighbours (large star, then small star) and
    takes O(log n) rounds on paths; a round is two equi-joins whose grouped side
    is pre-aggregated, so a hub costs one row per neighbour and nothing is
    collected. Up to `one_task` distinct edges, which are counted first, go
    through one task instead, which saves the rounds.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    now = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if one_task and now.count() <= one_task:
        return now.coalesce(1).mapInArrow(_in_one_task, "vertex long, component long")
    loops = now.where("u = v").select(F.col("u").alias("vertex"))
    now = now.where("u <> v")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # large star: neighbours above u move to the least vertex around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u itself, move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, now = now, materialise(small.distinct())
        release(last)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("vertex")).distinct()
    alone = loops.distinct().join(members.select("vertex").union(roots), "vertex", "left_anti")
    return members.union(roots.union(alone).select("vertex", F.col("vertex").alias("component")))
