"""Embedding near-duplicates by a random-projection tree forest with spill overlap."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.texts import give_back, portions
from weft.operators.components import connected_components
from weft.session import materialise

_GRID = float(1 << 24)  # unit vectors and directions are multiples of 1 / _GRID: their products add up exactly in any order, so every task finds the same leaves
_PAYS = 0.7  # two parts of a larger share of a node hold more pairs than the node
_BRANCH = 32  # leaves whose rows go to one task
_BLOCK = 1 << 20  # cosines at once
_HELD = 1 << 20  # links that are kept until their leaves are known
_ONE_TASK = 1_000_000  # components of up to so many links, 16 MB, are found in one task: the rounds of joins give the same


class Forest:
    """Trees over unit vectors of one length: a random direction for each level of a tree, a median for each node.

    A point within `margin` of a node's threshold goes down both sides. A node
    stays a leaf where no direction divides it so that fewer pairs are left.
    Nodes are numbered from 0 and leaf k is -1 - k; leaves rise from tree to
    tree. The first node on a path with at most `_BRANCH` leaves' rows, or a
    leaf above it, is a branch: its rows meet in one task, which divides them
    further. A leaf of more rows is dealt in `parts`, and every two parts meet.
    """

    def __init__(self, sample: np.ndarray, dim: int, scale: float, leaf_size: int, margin: float, trees: int, seed: int):
        self.points, self.scale, self.leaf_size, self.margin = _grid(_unit(sample)), scale, leaf_size, margin
        self.dim, self.seed = dim, seed
        self._clear()
        for t in range(trees):
            self.firsts.append(self.leaves)
            self.drawn = {}
            self.roots.append(self._grow(np.arange(len(sample)), t, 0, False))
            if self.roots[-1] < 0:  # this tree compares all pairs
                self._clear()
                self.firsts, self.roots = [0], [self._leaf(len(sample) * scale, True)]
                break
        used, self.way = np.unique(np.array(self.way, np.int64), return_inverse=True)
        self.ways = np.array(self.ways).reshape(-1, dim)[used].T
        self.kids = np.array(self.kids, np.int32).reshape(-1, 2)
        self.low, self.high = np.array(self.cuts) + margin, np.array(self.cuts) - margin
        self.firsts, self.roots, self.heads, self.parts = (np.array(x, np.int64) for x in (self.firsts, self.roots, self.heads, self.parts))
        self.branch = np.full(len(self.way) + self.leaves, -1, np.int32)  # by node; leaves count from the end
        self.branch[self.heads] = np.arange(len(self.heads))
        del self.points, self.drawn, self.cuts

    def _clear(self) -> None:
        self.leaves, self.firsts, self.roots, self.heads, self.parts = 0, [], [], [], []
        self.ways, self.way, self.cuts, self.kids, self.drawn = [], [], [], [], {}

    def _along(self, tree: int, level: int, attempt: int) -> tuple[int, np.ndarray]:
        """A direction's number, and the sample along it."""
        if (level, attempt) not in self.drawn:
            normal = np.random.default_rng([self.seed, tree, level, attempt]).standard_normal(self.dim)
            self.ways.append(_grid(normal / np.linalg.norm(normal)))
            self.drawn[level, attempt] = len(self.ways) - 1, self.points @ self.ways[-1]
        return self.drawn[level, attempt]

    def _leaf(self, rows: float, head: bool) -> int:
        self.leaves += 1
        if head:
            self.heads.append(-self.leaves)
            self.parts.append(max(1, math.ceil(rows / (_BRANCH * self.leaf_size))))
        return -self.leaves

    def _grow(self, at: np.ndarray, tree: int, level: int, inside: bool) -> int:
        rows = len(at) * self.scale
        if rows > self.leaf_size and len(at) >= 16:
            for attempt in range(3):  # other directions for a node that one doesn't divide
                way, along = self._along(tree, level, attempt)
                along = along[at]
                cut = float(np.median(along))
                low, high = along <= cut + self.margin, along > cut - self.margin
                if max(low.sum(), high.sum()) <= _PAYS * len(at):
                    node, head = len(self.way), not inside and rows <= _BRANCH * self.leaf_size
                    self.way.append(way)
                    self.cuts.append(cut)
                    self.kids.append(None)
                    if head:
                        self.heads.append(node)
                        self.parts.append(1)
                    self.kids[node] = tuple(self._grow(at[part], tree, level + 1, inside or head) for part in (low, high))
                    return node
        return self._leaf(rows, not inside)

    def _walk(self, unit: np.ndarray, starts: np.ndarray, to_branch: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) pairs where the rows end: leaves, or branches."""
        rows, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for start in range(0, len(unit), 2048):
            along = _grid(unit[start : start + 2048]) @ self.ways
            row, at = np.repeat(np.arange(len(along)), len(starts)), np.tile(np.asarray(starts, np.int32), len(along))
            while len(at):
                done = at < 0
                if to_branch:
                    done |= self.branch[at] >= 0
                rows.append(row[done] + start)
                ends.append(at[done])
                row, at = row[~done], at[~done]
                x = along[row, self.way[at]]
                low, high = x <= self.low[at], x > self.high[at]
                row, at = np.concatenate([row[low], row[high]]), np.concatenate([self.kids[at[low], 0], self.kids[at[high], 1]])
        return np.concatenate(rows), np.concatenate(ends)

    def deal(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, branch) pairs; a row may lie in several branches of a tree."""
        row, node = self._walk(unit, self.roots, True)
        return row, self.branch[node]

    def divide(self, unit: np.ndarray, branch: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of the rows of a branch."""
        row, node = self._walk(unit, self.heads[branch : branch + 1], False)
        return row, -1 - node

    def cells(self, unit: np.ndarray, branch: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of rows in the trees up to that of a branch, in order of rows."""
        leaf = self._walk(unit[:1], self.heads[branch : branch + 1], False)[1][0]
        row, node = self._walk(unit, self.roots[: np.searchsorted(self.firsts, -1 - leaf, "right")], False)
        order = np.argsort(row, kind="stable")
        return row[order], -1 - node[order]


class Seen:
    """What rows share of some leaves, the most common ones first, as words of 64 bits that are made when asked for."""

    def __init__(self, n: int, row: np.ndarray, leaf: np.ndarray):
        _, leaf, count = np.unique(leaf, return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        bit = rank[leaf]
        order = np.argsort(bit, kind="stable")
        self.n, self.row, self.bit, self.bits = n, row[order], bit[order], int((count > 1).sum())

    def word(self, start: int) -> np.ndarray:
        first, last = np.searchsorted(self.bit, [start, min(start + 64, self.bits)])
        found = np.zeros(self.n, np.uint64)
        np.bitwise_or.at(found, self.row[first:last], np.uint64(1) << (self.bit[first:last] - start).astype(np.uint64))
        return found

    def new(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that share nothing."""
        for start in range(0, self.bits, 64):
            if not len(x):
                break
            word = self.word(start)
            left = (word[x] & word[y]) == 0
            x, y = x[left], y[left]
        return x, y


def _unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first so that neither tiny nor huge components leave the range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _grid(rows: np.ndarray) -> np.ndarray:
    return np.rint(rows * _GRID) / _GRID


def _part(ids: np.ndarray, parts: int | np.ndarray) -> np.ndarray:
    """The part that each id lies in, of so many."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.asarray(parts, np.uint64)).astype(np.int64)


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least linked position of each of n positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near(one: np.ndarray, other: np.ndarray | None, threshold: float):
    """Linked pairs (i, j) of `one` and `other`, or of `one` alone with i < j, block by block."""
    start = 0
    while start < len(one) and (other is None or len(other)):
        rest = one[start:] if other is None else other
        own = one[start : start + max(1, min(256, _BLOCK // len(rest)))]
        i, j = np.divmod(np.flatnonzero(own @ rest.T >= threshold), len(rest))
        if other is None:
            i, j = i[j > i], j[j > i] + start
        if len(i):
            yield i + start, j
        start += len(own)


def _pairs(vectors: np.ndarray, a: np.ndarray, b: np.ndarray | None, known: np.ndarray, threshold: float):
    """Linked pairs of rows a and b, or of a alone, but those of two `known` rows."""
    if b is None:
        todo = [(a[~known[a]], None), (a[~known[a]], a[known[a]])]
    else:
        todo = [(a[~known[a]], b), (a[known[a]], b[~known[b]])]
    for one, other in todo:
        for i, j in _near(vectors[one], None if other is None else vectors[other], threshold):
            yield one[i], (one if other is None else other)[j]


def _links(forest: Forest, branch: int, sides: tuple[np.ndarray, np.ndarray] | None, copies: np.ndarray, vectors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of a branch, and the least row linked with it: each pair only in the first leaf that both its vectors share.

    Pairs are counted block by block and never listed as a whole; of a leaf with
    many the rows of the most common earlier leaf aren't compared again. With
    `sides` the branch is a leaf dealt in parts, and only pairs across count.
    """
    n = len(vectors)
    links, stars, pending, none = np.zeros(n), [np.zeros((2, 0), np.int64)], [], np.zeros(n, bool)

    def count(rows, seen, blocks):
        root, own = np.arange(len(rows)), np.zeros(len(rows))
        for x, y in blocks:
            x, y = seen.new(x, y)
            own += np.bincount(x, copies[rows[y]], len(rows)) + np.bincount(y, copies[rows[x]], len(rows))
            x, y = root[x], root[y]
            if (x != y).any():
                root = _local_roots(len(rows), x[x != y], y[x != y])[root]
        links[rows] += own
        stars.append(np.stack([rows, rows[root]])[:, root != np.arange(len(rows))])

    def settle():
        """Count the pairs of leaves with few: their rows go down the trees together."""
        if pending:
            all_rows = np.unique(np.concatenate([rows for _, rows, *_ in pending]))
            row, code = forest.cells(vectors[all_rows], branch)
            starts = np.searchsorted(row, np.arange(len(all_rows) + 1))
            for leaf, rows, x, y in pending:
                k = np.searchsorted(all_rows, rows)
                size = starts[k + 1] - starts[k]
                own, of = np.arange(size.sum()) + np.repeat(starts[k] - np.cumsum(size) + size, size), np.repeat(np.arange(len(rows)), size)
                earlier = code[own] < leaf
                count(rows, Seen(len(rows), of[earlier], code[own][earlier]), [(x, y)])
            pending.clear()

    row, code = forest.divide(vectors, branch)
    order = np.lexsort((row, code))
    row, code, held = row[order], code[order], 0
    cuts = np.flatnonzero(np.diff(code)) + 1
    for at, leaf in zip(np.split(row, cuts), code[np.concatenate([[0], cuts])], strict=True):
        a, b = (at, None) if sides is None else sides
        found, size = [np.zeros((2, 0), np.int64)], 0
        for pair in _pairs(vectors, a, b, none, threshold):
            found.append(np.stack(pair))
            size += len(pair[0])
            if size > _HELD:
                break
        if size > _HELD:
            del found, pair
            of, earlier = forest.cells(vectors[at], branch)
            seen = Seen(len(at), of[earlier < leaf], earlier[earlier < leaf])
            known, place = none.copy(), np.zeros(n, np.int64)
            known[at], place[at] = (seen.word(0) & np.uint64(1)) > 0, np.arange(len(at))
            count(at, seen, ((place[i], place[j]) for i, j in _pairs(vectors, a, b, known, threshold)))
        elif size:
            rows, ends = np.unique(np.concatenate(found, axis=1), return_inverse=True)
            pending.append((leaf, rows, *ends.reshape(2, -1)))
            held += size
            if held > _HELD:
                settle()
                held = 0
    settle()
    return links.astype(np.int64), _local_roots(n, *np.concatenate(stars, axis=1))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
    trees: int = 14, leaf_size: int = 1024, spill: float = 0.5, sample_rows: int = 40_000, seed: int = 17,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept): one per input row.

    Equal vectors are collapsed to the smallest id first (a hot vector becomes
    one row with a count). A forest of `trees` trees, fitted on at most about
    `sample_rows` distinct vectors, deals every vector to leaves of some
    `leaf_size` rows; the margin of the spill is `spill` standard deviations of
    what a random direction makes of a pair at the threshold. All pairs of a
    leaf are compared in double precision, each link counts in the first leaf
    that its two vectors share, and links are united to components. A vector is
    sent once for each branch of some 32 leaves; a task holds a branch and a
    block of its cosines, whatever their links.

    Null, empty or zero vectors and those with null or non-finite components
    link with nothing: n_links 0, a component of their own. Vectors of unlike
    lengths never link. Rows with a null id come back with 0 links, a null
    component and kept false. Rows that share an id are one vertex with one
    vector: the sound one of the least hash, if they differ; a repeated row
    changes nothing but comes back itself. Other columns are ignored. An empty
    table gives no rows.

    A near pair is parted in a tree if some node's cut falls between its two
    margins, which grows less likely with `spill`, and missed if all trees part
    it; a row's copies grow with trees * (1 + spill)^depth, so at many levels
    more trees with less spill cost less for the same recall.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("id", F.when(F.coalesce(sound, F.lit(False)) & F.col("id").isNotNull(), F.col("v")).alias("v"))
    hashes = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(seed), "v", F.lit(1)).alias("g")]
    given = rows.where("v is not null").select("id", "v", *hashes)
    # one vector an id, by hashes alone; then one row for all ids of a vector
    keyed = given.groupBy("id").agg(F.min(F.struct("h", "g")).alias("k")).select("id", "k.h", "k.g")
    owners = keyed.groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = materialise(given.groupBy("h", "g").agg(F.first("v").alias("v")).join(owners, ["h", "g"]))

    total = classes.count()
    share = min(1.0, sample_rows / max(1, total))
    picked = classes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(2 * sample_rows).toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in picked:
        by_dim.setdefault(len(v), []).append(v)
    chord = float(np.sqrt(2 - 2 * threshold))
    sent = np.float32 if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else np.float64

    def forest(sample, dim):
        return Forest(np.array(sample, dtype=np.float64).reshape(-1, dim), dim, 1 / share, leaf_size, spill * chord / dim**0.5, trees, seed)

    planted = spark.sparkContext.broadcast({dim: forest(sample, dim) for dim, sample in by_dim.items()})  # some 30 bytes a node
    del picked, by_dim

    def of(dim):
        return planted.value.get(dim) or forest([], dim)

    def deal(batches):
        for batch in portions(batches):
            lengths = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(lengths):
                own = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                points = own.column("v").flatten().to_numpy().reshape(-1, dim)
                ids, copies = own.column("id").to_numpy(), own.column("copies").to_numpy()
                trees = of(int(dim))
                row, branch = trees.deal(_unit(points))
                parts = trees.parts[branch]
                other = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                part = np.repeat(_part(ids[row], parts), parts)
                row, branch, points = np.repeat(row, parts), np.repeat(branch, parts), points.astype(sent)
                for k in range(0, len(row), 1 << 14):
                    at = row[k : k + (1 << 14)]
                    ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(points[:1].nbytes)
                    v = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(points[at])])
                    key = [x[k : k + (1 << 14)].astype(np.int32) for x in (np.full(len(row), dim), branch, np.minimum(part, other), np.maximum(part, other))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, key), pa.array(ids[at]), pa.array(copies[at]), v], names=["dim", "branch", "p", "q", "id", "copies", "v"])
        give_back()

    def compare(key, group):
        dim, branch, p, q = (x.as_py() for x in key)
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        points = np.frombuffer(b"".join(group["v"].to_pylist()), dtype=sent).reshape(-1, dim)[order].astype(np.float64)
        ids, copies, trees = ids[order], group["copies"].to_numpy()[order].astype(np.float64), of(dim)
        side = _part(ids, trees.parts[branch])
        links, root = _links(trees, branch, None if p == q else (np.flatnonzero(side == p), np.flatnonzero(side == q)), copies, _unit(points), threshold)
        hit = links > 0
        return pa.table({"id": ids[hit], "root": ids[root[hit]], "links": links[hit]})

    dealt = classes.select("id", "copies", "v").mapInArrow(deal, "dim int, branch int, p int, q int, id long, copies long, v binary")
    found = materialise(dealt.groupBy("dim", "branch", "p", "q").applyInArrow(compare, "id long, root long, links long"))

    component = connected_components(found.select("id", "root").distinct(), "id", "root", one_task=_ONE_TASK)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = (
        classes.select("h", "g", "id", "copies").withColumnRenamed("id", "class_id")
        .join(counts.withColumnRenamed("id", "class_id"), "class_id", "left")
        .join(component.withColumnRenamed("vertex", "class_id"), "class_id", "left")
        .select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "class_id").alias("c"))
    )
    of_id = keyed.join(per_class, ["h", "g"]).select(F.col("id").alias("__id"), "n", "c")
    return rows.select("id").join(of_id, F.col("id") == F.col("__id"), "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(False)).alias("kept"),
    )


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The forest over all of `embeddings`: links at cosine 0.9 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
