"""Relational building blocks over edges (src, dst, family, side, label) and pairs (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.labels import paired
from weft.operators.components import connected_components, united
from weft.session import grown, materialise, release

ONE_TASK = 1_000_000  # components of up to so many edges are found in one task


def adjacency(edges: DataFrame) -> DataFrame:
    """Pairs with an edge of any label."""
    return edges.select("src", "dst").distinct()


def edge_count(edges: DataFrame, *by: str) -> DataFrame:
    """Number of edges, by columns such as a component."""
    return edges.groupBy(*by).agg(F.count("*").alias("n_edges"))


def split(edges: DataFrame) -> DataFrame:
    """Adds `comp`, the smallest vertex of an edge's weak component; components of one vertex go, with their self-loops."""
    tagged, found = united(edges.where("src <> dst"))
    parts = tagged.join(found, "root", "left").select(*edges.columns, F.coalesce("component", "root").alias("comp"))
    loops = edges.where("src = dst")
    if loops.isEmpty():
        return parts
    of = parts.select(F.col("src").alias("vertex"), "comp").union(parts.select("dst", "comp")).distinct()
    return parts.union(loops.join(of, F.col("src") == F.col("vertex")).select(*edges.columns, "comp"))


def weak_components(edges: DataFrame) -> DataFrame:
    """Rows (vertex, component), as `connected_components` gives them, where edges of a component lie together."""
    tagged, found = united(edges)
    ends = tagged.select(F.explode(F.array("src", "dst")).alias("vertex"), "root")
    return ends.join(found, "root", "left").select("vertex", F.coalesce("component", "root").alias("component")).distinct()


def non_trivial(pairs: DataFrame) -> DataFrame:
    """Pairs of different vertices."""
    return pairs.where("src <> dst")


def intersection(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Pairs that are in all of them."""
    out = first.select("src", "dst").distinct()
    for other in others:
        out = out.join(other.select("src", "dst"), ["src", "dst"], "left_semi")
    return out


def difference(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Pairs of `upper` that `lower` lacks."""
    return upper.select("src", "dst").distinct().join(lower.select("src", "dst"), ["src", "dst"], "left_anti")


def union(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Pairs that are in any of them."""
    out = first.select("src", "dst")
    for other in others:
        out = out.union(other.select("src", "dst"))
    return out.distinct()


def transposed(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def push(pairs: DataFrame, rep: DataFrame) -> DataFrame:
    """Pairs of representatives for pairs of vertices; vertices without one stand for themselves. rep: (vertex, rep)."""
    left, right = (rep.select(F.col("vertex").alias(v), F.col("rep").alias(f"_{v}")) for v in ("src", "dst"))
    return pairs.join(left, "src", "left").join(right, "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).distinct()


def pull(pairs: DataFrame, rep: DataFrame) -> DataFrame:
    """Pairs of all members for pairs of representatives: the inverse of `push`."""
    left, right = (rep.select(F.col("rep").alias(v), F.col("vertex").alias(f"_{v}")) for v in ("src", "dst"))
    return pairs.join(left, "src", "left").join(right, "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).distinct()


# --- reachability that ignores labels --------------------------------------------------------------------------------------


def reachable(edges: DataFrame, starts: DataFrame, forward: bool = True) -> DataFrame:
    """Rows (start, vertex): each start and what it reaches, or what reaches it, at any distance; starts: (start).

    Frontiers: each round joins only the rows that are new. For many starts use
    the pairs themselves, one column suffices for one question (see `relevant`).
    """
    step = adjacency(edges) if forward else transposed(adjacency(edges))
    step = materialise(step.where("src <> dst"))
    seen = materialise(starts.select(F.col("start"), F.col("start").alias("vertex")).distinct())
    new = seen
    while True:
        found = new.join(step, new["vertex"] == step["src"]).select("start", F.col("dst").alias("vertex")).distinct()
        new = materialise(found.join(seen, ["start", "vertex"], "left_anti"))
        if new.isEmpty():
            release(new)
            return seen
        seen = grown(seen, new)


def closure(edges: DataFrame) -> DataFrame:
    """The reflexive transitive closure, as pairs over all vertices, by squaring: rounds are logarithmic in the longest way."""
    step = adjacency(edges)
    loops = step.select("src").union(step.select("dst")).distinct().select("src", F.col("src").alias("dst"))
    now = materialise(step.union(loops).distinct())
    n = now.count()
    while True:
        longer = now.select("src", F.col("dst").alias("mid")).join(now.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        last, now = now, materialise(longer.distinct())
        release(last)
        before, n = n, now.count()
        if n == before:
            return now


def scc(edges: DataFrame) -> DataFrame:
    """(vertex, scc): the smallest vertex that a vertex reaches and is reached by, found without any closure.

    Vertices without an edge in or out are trimmed: each is a component. Then
    every vertex takes the smallest one that reaches it as its colour; a vertex
    of its own colour is the smallest of its component, and what reaches it
    within the colour is that component. These go, and what is left is coloured
    again. Tables hold edges and one row a vertex, never pairs; a propagation
    only joins the rows that changed and takes as many rounds as its longest
    shortest way. Null ends are ignored; repeated edges count once.
    """
    all_ = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    vertices = materialise(all_.select(F.col("src").alias("vertex")).union(all_.select("dst")).distinct())
    left, done = materialise(all_.where("src <> dst")), []
    while True:
        while True:  # trim
            both = left.select(F.col("src").alias("v")).distinct().join(left.select(F.col("dst").alias("v")).distinct(), "v", "left_semi")
            core = left.join(both.select(F.col("v").alias("src")), "src", "left_semi").join(both.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst")
            last, left = left, materialise(core)
            n, before = left.count(), last.count()
            release(last)
            if n == before or not n:
                break
        if not n:
            break
        colour = _least(left, left.select(F.col("src").alias("vertex"), F.col("src").alias("colour")).distinct())
        own = left.join(colour.select(F.col("vertex").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("vertex").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        own = materialise(own.select("src", "dst"))
        back = _least(transposed(own), colour.where("vertex = colour"))
        done.append(back)
        gone = back.select("vertex")
        last, left = left, materialise(left.join(gone.withColumnRenamed("vertex", "src"), "src", "left_anti").join(gone.withColumnRenamed("vertex", "dst"), "dst", "left_anti").select("src", "dst"))
        release(last, own, colour)
    found = vertices.select("vertex", F.lit(None).cast(vertices.schema[0].dataType).alias("colour")).limit(0)
    for part in done:
        found = found.union(part.select("vertex", "colour"))
    return vertices.join(found, "vertex", "left").select("vertex", F.coalesce("colour", "vertex").alias("scc"))


def _least(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(vertex, colour): the smallest colour of `start` that reaches each vertex along the edges."""
    now = materialise(start.select("vertex", "colour"))
    new = now
    while True:
        came = new.join(edges, new["vertex"] == edges["src"]).groupBy(F.col("dst").alias("vertex")).agg(F.min("colour").alias("came"))
        better = came.join(now, "vertex", "left").where("colour is null or came < colour").select("vertex", F.col("came").alias("colour"))
        new = materialise(better)
        if new.isEmpty():
            release(new)
            return now
        last, now = now, materialise(now.join(new, "vertex", "left_anti").union(new))
        release(last)


def strong_components(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`scc`, and the reflexive closure (a, b) between components, taken over the graph of components alone."""
    of = materialise(scc(edges))
    between = push(adjacency(edges), of.select("vertex", F.col("scc").alias("rep")))
    return of, closure(between).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def relevant(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (x, y) for which some pair (s, t) has a way from s to x and from y to t. Labels stay as they are."""
    ahead = reachable(edges, pairs.select(F.col("src").alias("start")))
    behind = reachable(edges, pairs.select(F.col("dst").alias("start")), forward=False)
    front = pairs.select("src", "dst").distinct().join(ahead.select(F.col("start").alias("src"), F.col("vertex").alias("x")), "src")
    ways = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).distinct().join(front, "x")
    found = ways.join(behind.select(F.col("start").alias("dst"), F.col("vertex").alias("y")), ["dst", "y"], "left_semi").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()
    return edges.join(found, ["src", "dst"], "left_semi").select(edges.columns)


# --- clusters -----------------------------------------------------------------------------------------------------------------


def representatives(pairs: DataFrame) -> DataFrame:
    """(vertex, rep): the least member of each cluster of vertices that `pairs` join both ways."""
    both = non_trivial(pairs).select("src", "dst").distinct()
    both = both.join(transposed(both), ["src", "dst"], "left_semi")
    return connected_components(both, one_task=ONE_TASK).select("vertex", F.col("component").alias("rep"))


def condense(edges: DataFrame, rep: DataFrame) -> DataFrame:
    """Edges between clusters, each once; those inside one stay as self-loops, labels that lack a half go."""
    left, right = (rep.select(F.col("vertex").alias(v), F.col("rep").alias(f"_{v}")) for v in ("src", "dst"))
    moved = edges.join(left, "src", "left").join(right, "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "family", "side", "label")
    return paired(moved.distinct())


def expand(pairs: DataFrame, rep: DataFrame) -> DataFrame:
    """Pairs of members for pairs of clusters, and all pairs of different members of one cluster."""
    inside = rep.select(F.col("vertex").alias("src"), "rep").join(rep.select(F.col("vertex").alias("dst"), "rep"), "rep").where("src <> dst").select("src", "dst")
    return union(pull(pairs, rep), inside)


# --- value flow -----------------------------------------------------------------------------------------------------------------


def value_flow_edges(edges: DataFrame) -> DataFrame:
    """Edges whose ends both lie on a way from an opening bracket to a closing one, whatever their ids."""
    mark = lambda side, end: edges.where((F.col("family") == "b") & (F.col("side") == side)).select(F.col(end).alias("vertex")).distinct()
    ahead, behind = _spread(edges, mark("o", "src"), True), _spread(edges, mark("c", "dst"), False)
    keep = materialise(ahead.join(behind, "vertex", "left_semi"))
    left = edges.join(keep.withColumnRenamed("vertex", "src"), "src", "left_semi")
    return left.join(keep.withColumnRenamed("vertex", "dst"), "dst", "left_semi").select(edges.columns)


def _spread(edges: DataFrame, starts: DataFrame, forward: bool) -> DataFrame:
    """All vertices that some start reaches, or that reach one: frontiers without their starts."""
    step = adjacency(edges) if forward else transposed(adjacency(edges))
    step = materialise(step.where("src <> dst"))
    seen = new = materialise(starts)
    while True:
        found = step.join(new.withColumnRenamed("vertex", "src"), "src", "left_semi").select(F.col("dst").alias("vertex")).distinct()
        new = materialise(found.join(seen, "vertex", "left_anti"))
        if new.isEmpty():
            release(new)
            return seen
        seen = grown(seen, new)


def bracket_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with a way whose first edge opens a bracket and whose last closes one of the same id."""
    opens = edges.where("family = 'b' and side = 'o'").select("src", F.col("dst").alias("a"), "label").distinct()
    closes = edges.where("family = 'b' and side = 'c'").select(F.col("src").alias("b"), "dst", "label").distinct()
    own = pairs.select("src", "dst").distinct()
    inner = own.join(opens, "src").join(closes, ["dst", "label"])
    reach = reachable(edges, inner.select(F.col("a").alias("start")).distinct())
    return inner.join(reach.select(F.col("start").alias("a"), F.col("vertex").alias("b")), ["a", "b"], "left_semi").select("src", "dst").distinct()
