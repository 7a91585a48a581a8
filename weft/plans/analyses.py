"""The analyses over DataFrames: under-, over- and on-demand approximation, by component.

strategy "grouped" runs the kernel once per weak component, "blocks" the bit
sets of `weft.plans.blocks`, dealt over tasks by source vertex, "relational" the
joins of `weft.plans.fixpoint`; "auto", the default, finds the components and
counts the edges of the largest one first: up to `largest` edges they are
grouped, beyond that they go by blocks. The kernel holds up to the square of a
component's vertices a state and its time grows faster, so where a language is
solved the bound is `SOLVED`, elsewhere `LARGEST`.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import graph
from weft.plans import blocks, fixpoint, kernel, memo
from weft.plans.languages import Language
from weft.session import materialise

#: Edges of a component that one task takes where labels don't matter, and where a language is solved: facts grow with the square.
LARGEST, SOLVED = 200_000, 2_000
_SOLVERS = {"blocks": blocks.Blocks, "relational": fixpoint.Facts}
_EDGE = ["src", "dst", "family", "side", "label"]


def _edges(part: pd.DataFrame) -> set[kernel.Edge]:
    return set(zip(part["src"].tolist(), part["dst"].tolist(), part["family"].tolist(), part["side"].tolist(), part["label"].tolist(), strict=True))


def _pairs(part: pd.DataFrame) -> set[tuple[int, int]]:
    return set(zip(part["src"].tolist(), part["dst"].tolist(), strict=True))


_frame = sorted
"""Rows of pairs in order."""


def _table(pairs) -> pd.DataFrame:
    pairs = sorted(pairs)
    return pd.DataFrame({"src": pd.Series([p[0] for p in pairs], dtype="int64"), "dst": pd.Series([p[1] for p in pairs], dtype="int64")})


def _strategy(edges: DataFrame, strategy: str, largest: int) -> tuple[DataFrame, type | None]:
    """The edges with their components, found once, and what solves them; None is the kernel."""
    parts = materialise(graph.split(edges.select(_EDGE)))
    if strategy == "auto":
        most = graph.edge_count(parts, "comp").agg(F.max("n_edges")).first()[0]
        return parts, None if (most or 0) <= largest else blocks.Blocks
    return parts, None if strategy == "grouped" else _SOLVERS[strategy]


def by_component(parts: DataFrame, run, schema: str = "src long, dst long") -> DataFrame:
    """Rows that `run` makes of the edges of each component; parts: edges with `comp`."""
    return _by_kind(parts.select("comp", F.lit("").alias("kind"), *_EDGE), lambda of: run(of[""]), schema)


def _by_kind(rows: DataFrame, run, schema: str) -> DataFrame:
    """Rows that `run` makes of the sets of edges of each component, by kind.

    rows: edges with `comp` and `kind`. Components are dealt by hash and come in
    order as one stream of Arrow batches, so that small ones, of which there may
    be millions, cost no data frame each.
    """
    out = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in schema.split(", "))])
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(batches):
        own, of, found = None, None, []

        def flush():
            columns = list(zip(*found, strict=True)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for batch in batches:
            columns = batch.to_pydict()
            for comp, kind, *edge in zip(*(columns[c] for c in ("comp", "kind", *_EDGE)), strict=True):
                if comp != own:
                    if of:
                        found.extend(run(of))
                        if len(found) >= 10_000:
                            yield from flush()
                            found.clear()
                    own, of = comp, defaultdict(set)
                of[kind].add(tuple(edge))
        if of:
            found.extend(run(of))
        yield from flush()

    return rows.repartition(spread, "comp").sortWithinPartitions("comp").mapInArrow(solve, schema)


def _runner(equal_once: bool):
    return memo.once if equal_once else by_component


def language_pairs(edges: DataFrame, language: Language, strategy: str = "auto", largest: int = SOLVED, equal_once: bool = False) -> DataFrame:
    """Pairs with a path in the language, labels ranked within each component."""
    parts, solve = _strategy(edges, strategy, largest)
    return _runner(equal_once)(parts, lambda own: _frame(kernel.Solver(own, language).reach())) if solve is None else solve(parts, language).reach()


def unknown_pairs(edges: DataFrame, language: Language, strategy: str = "auto", largest: int = SOLVED) -> DataFrame:
    """Pairs of the language that the under-approximation lacks, compared where a component is solved: no pair leaves one."""
    parts, solve = _strategy(edges, strategy, largest)
    if solve is None:
        return by_component(parts, lambda own: _frame(kernel.Solver(own, language).reach() - kernel.under(own)))
    return graph.difference(solve(parts, language).reach(), fixpoint.under_approximation(parts, False, solve))


def common_pairs(edges: DataFrame, languages: list[Language], strategy: str = "auto", largest: int = SOLVED) -> DataFrame:
    """Pairs with a path in each of the languages, compared where a component is solved."""
    parts, solve = _strategy(edges, strategy, largest)
    if solve is None:
        return by_component(parts, lambda own: _frame(set.intersection(*[kernel.Solver(own, language).reach() for language in languages])))
    return graph.intersection(*[solve(parts, language).reach() for language in languages])


def useful_edges(edges: DataFrame, language: Language, strategy: str = "auto", largest: int = SOLVED) -> DataFrame:
    """Edges on paths of the language between different vertices."""
    parts, solve = _strategy(edges, strategy, largest)
    return by_component(parts, lambda own: _edge_frame(kernel.Solver(own, language).useful()), _EDGES_SQL) if solve is None else solve(parts, language).useful().select(_EDGE)


def under_approximation(edges: DataFrame, valueflow: bool = False, strategy: str = "auto", largest: int = SOLVED, equal_once: bool = False) -> DataFrame:
    """Pairs joined by a path on which both families nest, also across each other."""
    parts, solve = _strategy(edges, strategy, largest)
    return _runner(equal_once)(parts, lambda own: _frame(kernel.under(own, valueflow))) if solve is None else fixpoint.under_approximation(parts, valueflow, solve)


def over_approximation(
    edges: DataFrame, method: str, known: DataFrame | None = None, valueflow: bool = False, strategy: str = "auto", largest: int = SOLVED, equal_once: bool = False
) -> DataFrame:
    """Pairs left by mutual refinement under a method; `known` pairs condense the graph first."""
    if known is None:
        parts, solve = _strategy(edges, strategy, largest)
        return _runner(equal_once)(parts, lambda own: _frame(kernel.over(own, method, None, valueflow))) if solve is None else fixpoint.over_approximation(parts, method, valueflow, solve)
    rep = materialise(graph.representatives(known))
    small = materialise(graph.condense(edges, rep))
    return graph.expand(over_approximation(small, method, None, valueflow, strategy, largest, equal_once), rep)


def over_condensed(edges: DataFrame, method: str, valueflow: bool = False, strategy: str = "auto", largest: int = SOLVED, equal_once: bool = False) -> DataFrame:
    """`over_approximation` with the pairs of `under_approximation` as `known`, both at once by component.

    Each label of the edges has both halves, as `paired` leaves them: condensing takes none.
    """
    parts, solve = _strategy(edges, strategy, largest)
    if solve is None:
        return _runner(equal_once)(parts, lambda own: _frame(kernel.over_condensed(own, method, kernel.under(own, valueflow), valueflow, whole=False)))
    known = materialise(fixpoint.under_approximation(parts, valueflow, solve))
    return over_approximation(parts.select(_EDGE), method, known, valueflow, strategy, largest)


def _of_component(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs with the component of their source; pairs across components are in none."""
    place = parts.select(F.col("src").alias("v"), "comp").union(parts.select(F.col("dst").alias("v"), "comp")).distinct()
    return pairs.select("src", "dst").join(place, F.col("src") == F.col("v")).select("src", "dst", F.col("comp").alias("own"))


def with_pairs(parts: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """Rows that `run` makes of the edges and the pairs of each component; parts: edges with `comp`."""
    return _by_kind(_as_edges(parts, edge=None, pair=_of_component(pairs, parts)), lambda of: run(of["edge"], _ends(of["pair"])), schema)


def _as_edges(parts: DataFrame, **pairs: DataFrame | None) -> DataFrame:
    """Edges of components and their pairs (src, dst, own), these as edges without a label, with their `kind`; None stands for the edges."""
    kinds = [
        parts.select("comp", F.lit(kind).alias("kind"), *_EDGE)
        if own is None
        else own.select(F.col("own").alias("comp"), F.lit(kind).alias("kind"), "src", "dst", F.lit(kind).alias("family"), F.lit("n").alias("side"), F.lit(0).cast("long").alias("label"))
        for kind, own in pairs.items()
    ]
    return reduce(DataFrame.union, kinds)


def _ends(edges: set[kernel.Edge]) -> set[tuple[int, int]]:
    return {e[:2] for e in edges}


_edge_frame = sorted
"""Rows of edges in order."""


_EDGES_SQL = "src long, dst long, family string, side string, label long"


def relevant_edges(edges: DataFrame, pairs: DataFrame, strategy: str = "auto", largest: int = LARGEST) -> DataFrame:
    """`graph.relevant`, by component where that can be: no round per step of a way."""
    parts, solve = _strategy(edges, strategy, largest)
    return with_pairs(parts, pairs, lambda e, p: _edge_frame(kernel.relevant(e, p)), _EDGES_SQL) if solve is None else graph.relevant(parts, pairs).select(_EDGE)


def value_flow_edges(edges: DataFrame, strategy: str = "auto", largest: int = LARGEST) -> DataFrame:
    """`graph.value_flow_edges`, by component where that can be."""
    parts, solve = _strategy(edges, strategy, largest)
    return by_component(parts, lambda own: _edge_frame(kernel.value_flow_edges(own)), _EDGES_SQL) if solve is None else graph.value_flow_edges(parts).select(_EDGE)


def bracket_pairs(edges: DataFrame, pairs: DataFrame, strategy: str = "auto", largest: int = LARGEST) -> DataFrame:
    """`graph.bracket_pairs`, by component where that can be."""
    parts, solve = _strategy(edges, strategy, largest)
    return with_pairs(parts, pairs, lambda e, p: _frame(kernel.bracket_pairs(e, p)), "src long, dst long") if solve is None else graph.bracket_pairs(parts, pairs)


def on_demand(
    edges: DataFrame, known: DataFrame, upper: DataFrame, parity_d: bool = False, valueflow: bool = False,
    strategy: str = "auto", largest: int = LARGEST, together: int = 2_000, splits: int = 8, equal_once: bool = False,
) -> DataFrame:
    """Pairs between `known` and `upper` that stay when each is refined by itself.

    Grouped, a component of up to `together` edges is done in one task, and only
    if it has a pair to decide. Pairs of a larger one are dealt to `splits`
    tasks, each with the component's edges. Relational, every pair gets its own
    copy of the edges that matter to it, and all pairs are refined side by side.
    """
    known, upper = (materialise(p.select("src", "dst").distinct()) for p in (known, upper))
    parts, solve = _strategy(edges, strategy, largest)
    if solve is not None:
        return _on_demand(parts, known, upper, parity_d, lambda e, k, u, m: _relational_pairs(e, k, u, m, valueflow, solve), graph.relevant)
    size = graph.edge_count(parts, "comp")
    # candidates decide which components are looked at, and by whom
    asked = _of_component(graph.difference(upper, known), parts).select(F.col("own").alias("comp")).distinct()
    sizes = materialise(asked.join(size, "comp"))
    small = parts.join(sizes.where(F.col("n_edges") <= together), "comp", "left_semi")

    def decide(own: set) -> list[tuple[int, int]]:
        pairs = {kind: _ends({e for e in own if e[2] == kind}) for kind in ("known", "upper")}
        edges_ = {e for e in own if e[2] not in pairs}
        return _frame(kernel.on_demand(edges_, pairs["known"], pairs["upper"], parity_d, valueflow) - pairs["known"])

    given = _as_edges(small, edge=None, known=_of_component(known, small), upper=_of_component(upper, small)).drop("kind")
    found = graph.union(known, _runner(equal_once)(given, decide))
    rest = sizes.where(F.col("n_edges") > together)
    if rest.isEmpty():
        return found
    large = materialise(parts.join(rest, "comp", "left_semi"))
    more = _on_demand(large, known, _of_component(upper, large).select("src", "dst"), parity_d, lambda e, k, u, m: _dealt_pairs(e, k, u, m, valueflow, splits), lambda e, p: relevant_edges(e, p, "grouped"))
    return graph.union(found, more)


def _on_demand(edges: DataFrame, known: DataFrame, upper: DataFrame, parity_d: bool, refine, relevant) -> DataFrame:
    """Two refinements, each on the written edges that matter to what is open; `parity_d` stops after the first."""
    found = materialise(refine(materialise(relevant(edges, upper).select(_EDGE)), known, upper, "default"))
    if parity_d:
        return found
    return refine(materialise(relevant(edges, found).select(_EDGE)), known, found, "all")


def _dealt_pairs(edges: DataFrame, known: DataFrame, upper: DataFrame, method: str, valueflow: bool, splits: int) -> DataFrame:
    rep = materialise(graph.representatives(known))
    small = materialise(graph.split(graph.condense(edges, rep)))
    own = _of_component(graph.push(graph.difference(upper, known), rep), small)
    dealt = materialise(own.withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.lit(splits))).select("src", "dst", F.col("own").alias("comp"), "part"))
    spread = small.join(dealt.select("comp", "part").distinct(), "comp").select(*_EDGE, "comp", "part")

    def refine(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        edges_ = _edges(part)
        return _table(p for p in sorted(_pairs(own)) if kernel.over(edges_, method, p, valueflow))

    confirmed = spread.groupBy("comp", "part").cogroup(dealt.toDF("src", "dst", "own", "share").groupBy("own", "share")).applyInPandas(refine, "src long, dst long")
    return graph.union(known, graph.pull(confirmed, rep))


def _relational_pairs(edges: DataFrame, known: DataFrame, upper: DataFrame, method: str, valueflow: bool, solve) -> DataFrame:
    rep = materialise(graph.representatives(known))
    small = materialise(graph.split(graph.condense(edges, rep)).select(_EDGE))
    candidates = graph.push(graph.difference(upper, known), rep)
    return graph.union(known, graph.pull(fixpoint.confirmed(small, candidates, method, valueflow, solve), rep))
