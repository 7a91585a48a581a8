"""The languages as joins: facts, useful edges and mutual refinement over all components at once.

A fact (u, v, mask, first, last) says that a path from u to v has its balanced
family nested and the other one in that state. States compose by exclusive or
of masks and by the outer ends; 0 stands for no end seen, 1 for an opening and
2 for a closing label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.labels import masked, paired
from weft.operators import graph
from weft.plans.languages import ERASED, METHODS, UNION, Language, excluding
from weft.session import grown, materialise, release

_STATE = ["mask", "first", "last"]
_FACT = ["u", "v", *_STATE]


def _accepted(language: Language) -> Column:
    ends = (F.col("first") == 0) | ((F.col("first") == 1) & (F.col("last") == 2)) if language.endpoints else F.lit(True)
    return (F.col("mask") == 0) & ends


def _compose(a: str, b: str) -> list[Column]:
    c = F.col
    return [
        c(f"{a}.mask").bitwiseXOR(c(f"{b}.mask")).alias("mask"),
        F.when(c(f"{a}.first") == 0, c(f"{b}.first")).otherwise(c(f"{a}.first")).alias("first"),
        F.when(c(f"{b}.last") == 0, c(f"{a}.last")).otherwise(c(f"{b}.last")).alias("last"),
    ]


class Facts:
    """The least fixpoint of a language over edges with a `comp` column, and what it was made of."""

    def __init__(self, edges: DataFrame, language: Language):
        self.language = language
        edges = materialise(masked(edges, language, "comp"))
        side = F.when(F.col("side") == "o", 1).when(F.col("side") == "c", 2).otherwise(0) if language.endpoints else F.lit(0)
        counted = (F.col("family") == "n") | (F.col("family") == F.lit(language.counted))
        self.steps = edges.where(counted).select("*", side.alias("first"), side.alias("last"))
        name = F.lit(0).alias("name") if language.balanced == "erased" else F.struct("family", "label").alias("name")
        nested = edges.where(~counted | F.lit(language.counted).isNull() & (F.col("family") != "n"))
        self.opens = nested.where("side = 'o'").select(F.col("src").alias("x"), F.col("dst").alias("u"), name)
        self.closes = nested.where("side = 'c'").select(F.col("src").alias("v"), F.col("dst").alias("y"), name)
        self.edges, self.nested, self.name = edges, nested, name
        ends = edges.select("src").union(edges.select("dst")).distinct()
        zero = [F.lit(0).alias(c) for c in _STATE]
        base = self.steps.select(F.col("src").alias("u"), F.col("dst").alias("v"), *_STATE)
        start = ends.select(F.col("src").alias("u"), F.col("src").alias("v"), *zero).union(base).distinct()
        self.all = self._close(start)

    def _blocks(self, facts: DataFrame) -> DataFrame:
        """Facts around facts: an opening before, the closing of its name behind."""
        return facts.join(self.opens, "u").join(self.closes, ["v", "name"]).select(F.col("x").alias("u"), F.col("y").alias("v"), *_STATE)

    def _close(self, start: DataFrame) -> DataFrame:
        seen = new = materialise(start)
        while True:
            a, b = new.alias("a"), seen.alias("b")
            ahead = a.join(b, F.col("a.v") == F.col("b.u")).select(F.col("a.u").alias("u"), F.col("b.v").alias("v"), *_compose("a", "b"))
            behind = b.join(a, F.col("b.v") == F.col("a.u")).select(F.col("b.u").alias("u"), F.col("a.v").alias("v"), *_compose("b", "a"))
            found = ahead.union(behind).union(self._blocks(new)).distinct()
            new = materialise(found.join(seen, _FACT, "left_anti"))
            if new.isEmpty():
                release(new)
                return seen
            seen = grown(seen, new)

    def accepted_pairs(self) -> DataFrame:
        """Pairs with an accepted path, a vertex and itself among them."""
        return self.all.where(_accepted(self.language)).select(F.col("u").alias("src"), F.col("v").alias("dst")).distinct()

    def reach(self) -> DataFrame:
        """Pairs of different vertices with an accepted path."""
        return self.accepted_pairs().where("src <> dst")

    def useful(self, targets: DataFrame | None = None) -> DataFrame:
        """Edges on accepted paths between different vertices, or of the target pairs (src, dst)."""
        roots = self.all.where(_accepted(self.language))
        if targets is None:
            roots = roots.where("u <> v")
        else:
            roots = roots.join(targets.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_semi")
        need = new = materialise(roots.select(_FACT))
        while True:
            # either part of a needed path is needed; inside a block, what it encloses
            want = new.alias("n")
            parts = want.join(self.all.alias("a"), F.col("n.u") == F.col("a.u")).join(self.all.alias("b"), (F.col("a.v") == F.col("b.u")) & (F.col("b.v") == F.col("n.v")))
            mask, first, last = _compose("a", "b")
            parts = parts.where((mask == F.col("n.mask")) & (first == F.col("n.first")) & (last == F.col("n.last")))
            halves = parts.select(F.explode(F.array(*[F.struct(*[F.col(f"{k}.{c}").alias(c) for c in _FACT]) for k in "ab"])).alias("f")).select("f.*")
            inner = want.join(self.opens.alias("o"), F.col("n.u") == F.col("o.x")).join(self.closes.alias("c"), (F.col("c.y") == F.col("n.v")) & (F.col("c.name") == F.col("o.name")))
            inner = inner.select(F.col("o.u").alias("u"), F.col("c.v").alias("v"), *[F.col(f"n.{c}").alias(c) for c in _STATE]).join(self.all, _FACT, "left_semi")
            found = halves.union(inner.select(_FACT)).distinct()
            new = materialise(found.join(need, _FACT, "left_anti"))
            if new.isEmpty():
                release(new)
                break
            need = grown(need, new)
        columns = ["src", "dst", "family", "side", "label", "comp"]
        step = self.steps.join(need.withColumnsRenamed({"u": "src", "v": "dst"}), ["src", "dst", *_STATE], "left_semi").select(columns)
        outer = need.withColumnsRenamed({"u": "x", "v": "y"}).join(self.opens, "x").join(self.closes, ["y", "name"])
        outer = outer.join(self.all, ["u", "v", *_STATE], "left_semi").select("x", "u", "v", "y", "name").distinct()
        halves = self.nested.select("*", self.name)
        opening = halves.where("side = 'o'").join(outer.select(F.col("x").alias("src"), F.col("u").alias("dst"), "name"), ["src", "dst", "name"], "left_semi")
        closing = halves.where("side = 'c'").join(outer.select(F.col("v").alias("src"), F.col("y").alias("dst"), "name"), ["src", "dst", "name"], "left_semi")
        return step.union(opening.select(columns)).union(closing.select(columns)).distinct()


def under_approximation(edges: DataFrame, valueflow: bool = False, solve=Facts) -> DataFrame:
    """edges: with `comp`; solve: `Facts` or `blocks.Blocks`."""
    facts = solve(edges, UNION)
    pairs = facts.reach()
    return graph.bracket_pairs(facts.useful(), pairs) if valueflow else pairs


def over_approximation(edges: DataFrame, method: str, valueflow: bool = False, solve=Facts) -> DataFrame:
    """Mutual refinement of all components side by side; a component is done in the round that keeps its edges. edges: with `comp`."""
    plan, done = METHODS[method], []
    now = edges
    while not now.isEmpty():
        before = graph.edge_count(now, "comp").withColumnRenamed("n_edges", "n_before")
        current, reached = now, []
        for language in (plan.alpha, plan.beta, *([ERASED] if plan.project else [])):
            facts = solve(current, language)
            reached.append(materialise(facts.reach()))
            current = materialise(paired(facts.useful(), "comp"))
        if plan.exclude:
            j = 0
            while True:  # components with fewer brackets than j are through
                labels = current.where("family = 'b'").groupBy("comp").agg(F.count_distinct("label").alias("n"))
                active = materialise(labels.where(F.col("n") > j).select("comp"))
                if active.isEmpty():
                    break
                facts = solve(current.join(active, "comp", "left_semi").select(current.columns), excluding(j))
                rest = current.join(active, "comp", "left_anti").select(current.columns)
                current = materialise(paired(facts.useful(), "comp").select(current.columns).union(rest))
                j += 1
        if valueflow:
            reached[1] = materialise(graph.bracket_pairs(current, reached[1]))
            current = materialise(graph.value_flow_edges(current))
        counts = before.join(graph.edge_count(current, "comp"), "comp", "left")
        ended = materialise(counts.where("n_edges is null or n_edges = n_before").select("comp"))
        of = now.select(F.col("src"), "comp").distinct()
        pairs = graph.intersection(*reached).join(of, "src").join(ended, "comp", "left_semi").select("src", "dst")
        done.append(materialise(pairs))
        left = current.join(ended, "comp", "left_anti").select("src", "dst", "family", "side", "label")
        now = materialise(graph.split(left))
    if not done:
        return edges.select("src", "dst").limit(0)
    return graph.union(*done)


def confirmed(edges: DataFrame, pairs: DataFrame, method: str, valueflow: bool = False, solve=Facts) -> DataFrame:
    """The pairs (src, dst) that mutual refinement for each pair by itself leaves.

    Every pair gets a copy of the edges that lie on its ways, with vertices of
    its own, so one set of joins refines all pairs at once: a pair is dropped
    with the first language that has no path for it, edges are those on paths of
    the pair, and a pair whose edges a round leaves as they are is confirmed.
    """
    plan = METHODS[method]
    number = lambda df: df.withColumn("comp", F.monotonically_increasing_id())
    asked = materialise(number(pairs.select("src", "dst").distinct()))
    ways = _ways(edges, asked)
    names = ways.select("comp", F.col("src").alias("v")).union(ways.select("comp", F.col("dst").alias("v"))).distinct()
    names = materialise(names.withColumn("id", F.monotonically_increasing_id()))
    own = lambda c: names.select("comp", F.col("v").alias(c), F.col("id").alias(f"_{c}"))
    columns = ["src", "dst", "family", "side", "label", "comp"]
    renamed = lambda df, *more: df.join(own("src"), ["comp", "src"]).join(own("dst"), ["comp", "dst"]).select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *more, "comp")
    now = materialise(renamed(ways, "family", "side", "label"))
    alive = materialise(renamed(asked))
    done = alive.limit(0)
    while not alive.isEmpty():
        before = graph.edge_count(now, "comp").withColumnRenamed("n_edges", "n_before")
        current, j = now, -1
        todo = [plan.alpha, plan.beta, *([ERASED] if plan.project else [])]
        while todo or plan.exclude:
            if todo:
                language, active = todo.pop(0), None
            else:
                j += 1
                labels = current.where("family = 'b'").groupBy("comp").agg(F.count_distinct("label").alias("n"))
                active = materialise(labels.where(F.col("n") > j).select("comp"))
                if active.isEmpty():
                    break
                language = excluding(j)
            part, asking = (current, alive) if active is None else (d.join(active, "comp", "left_semi").select(d.columns) for d in (current, alive))
            rest, others = (None, None) if active is None else (d.join(active, "comp", "left_anti").select(d.columns) for d in (current, alive))
            facts = solve(part, language)
            found = materialise(asking.join(facts.accepted_pairs(), ["src", "dst"], "left_semi").select(asking.columns))
            useful = paired(facts.useful(found), "comp").select(columns)
            current = materialise(useful if rest is None else useful.union(rest.select(columns)))
            alive = materialise(found if others is None else found.union(others))
        if valueflow:
            current = materialise(graph.value_flow_edges(current).select(columns))
        counts = alive.select("comp").join(before, "comp", "left").join(graph.edge_count(current, "comp"), "comp", "left")
        ended = materialise(counts.where("n_edges is null or n_edges = n_before").select("comp"))
        done = materialise(done.union(alive.join(ended, "comp", "left_semi").select(alive.columns)))
        alive = materialise(alive.join(ended, "comp", "left_anti").select(alive.columns))
        # what is left of a pair must hold two vertices, as components do
        two = current.where("src <> dst").select("comp").distinct()
        alive = materialise(alive.join(two, "comp", "left_semi").select(alive.columns))
        now = materialise(graph.relevant(current.join(alive.select("comp"), "comp", "left_semi").select(columns), alive.select("src", "dst")).select(columns))
    return asked.join(done.select("comp"), "comp", "left_semi").select("src", "dst")


def _ways(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (edge, comp): for each pair (src, dst, comp) the edges with a way from src before and one to dst behind."""
    ahead = graph.reachable(edges, pairs.select(F.col("src").alias("start")).distinct()).toDF("s", "x")
    behind = graph.reachable(edges, pairs.select(F.col("dst").alias("start")).distinct(), forward=False).toDF("t", "y")
    front = pairs.select(F.col("src").alias("s"), F.col("dst").alias("t"), "comp").join(ahead, "s")
    ways = front.join(edges.select("*", F.col("src").alias("x"), F.col("dst").alias("y")), "x").join(behind, ["t", "y"], "left_semi")
    return materialise(ways.select("src", "dst", "family", "side", "label", "comp").distinct())
