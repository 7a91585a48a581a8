"""The solver by blocks of sources against the kernel, which other tests hold against the definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_methods import EDGE, SEEDS, tangle
from weft.operators import graph
from weft.plans import analyses, kernel
from weft.plans.blocks import Blocks, compose
from weft.plans.languages import ERASED, METHODS, UNION, Language, excluding
from weft.session import materialise


def _apart(graphs):
    return [{(a + 100 * k, b + 100 * k, *r) for a, b, *r in g} for k, g in enumerate(graphs)]


@pytest.fixture(scope="module")
def tangles(spark):
    """The seven graphs that tell the methods apart, as components of one table."""
    each = _apart([tangle(s) for s in SEEDS])
    return each, materialise(spark.createDataFrame([e for g in each for e in g], EDGE))


def _rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("language", [UNION, ERASED, METHODS["se"].alpha, METHODS["se"].beta, excluding(1)])
def test_facts_and_useful_edges(tangles, language):
    each, edges = tangles
    parts = [c for g in each for c in kernel.components(g)]
    found = Blocks(materialise(graph.split(edges)), language, per_task=2)
    assert _rows(found.reach()) == set().union(*[kernel.Solver(c, language).reach() for c in parts])
    assert {r[:5] for r in _rows(found.useful())} == set().union(*[kernel.Solver(c, language).useful() for c in parts])


def test_useful_edges_of_targets(tangles):
    each, edges = tangles
    language = METHODS["parity"].alpha
    pairs = sorted(kernel.Solver(each[0], language).reach())[:3]
    found = Blocks(materialise(graph.split(edges)), language)
    for pair in pairs[:2]:
        targets = edges.sparkSession.createDataFrame([pair], "src long, dst long")
        assert {r[:5] for r in _rows(found.useful(targets))} == kernel.Solver(each[0], language).useful(pair)


def test_mutual_refinement(tangles):
    each, edges = tangles
    assert _rows(analyses.over_approximation(edges, "se", strategy="blocks")) == set().union(*[kernel.over(g, "se") for g in each])


def test_many_groups(spark):
    """k = 40: states are those met, masks are 64 bits wide. A walk must meet every label an even number of times."""
    edges = [(i, i + 1, "b", "o" if i < 45 else "c", i % 45) for i in range(90)] + [(90, 91, "b", "o", 50), (91, 90, "b", "c", 50)]
    df = materialise(graph.split(spark.createDataFrame(edges, EDGE)))
    ranks = {label: k for k, label in enumerate(sorted({e[4] for e in edges}))}
    bit = lambda e: 1 << ranks[e[4]] % 40
    want = set()
    for u in range(92):
        seen, todo = {(u, 0)}, [(u, 0)]
        while todo:
            v, mask = todo.pop()
            for e in edges:
                if e[0] == v and (to := (e[1], mask ^ bit(e))) not in seen:
                    seen.add(to)
                    todo.append(to)
        want |= {(u, v) for v, mask in seen if v != u and not mask}
    assert _rows(Blocks(df, Language("p", 40)).reach()) == want and want


def test_masks_of_any_width(spark):
    from weft.functions.labels import masked

    one = spark.createDataFrame([(0, 1, "b", "o", k) for k in range(64)], EDGE)
    for k in (1, 31, 32, 63):
        assert {r.label: r.mask for r in masked(one, Language("p", k)).select("label", F.col("mask").cast("long").alias("mask")).collect()} == {x: 1 << x % k for x in range(64)}
    with pytest.raises(ValueError, match="between 1 and 63"):
        masked(one, Language("p", 64))


def test_states_compose():
    rng = random.Random(1)
    some = [(rng.randrange(8), *rng.choice([(0, 0), (1, 1), (1, 2), (2, 1), (2, 2)])) for _ in range(20)]
    assert all(compose(compose(a, b), c) == compose(a, compose(b, c)) for a in some for b in some for c in some)
    assert all(compose((0, 0, 0), a) == a == compose(a, (0, 0, 0)) for a in some)


def test_strong_components(spark):
    """Chains, rings, rings joined one way, loops, random graphs; against reachability by hand."""
    rng = random.Random(5)
    graphs = [[(i, i + 1) for i in range(6)], [(i, (i + 1) % 7) for i in range(7)], [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (9, 9), (3, 4)], *[[(rng.randrange(14), rng.randrange(14)) for _ in range(m)] for m in (10, 18, 26)]]
    edges = [(a + 100 * k, b + 100 * k) for k, g in enumerate(graphs) for a, b in g]
    reach = {(v, v) for e in edges for v in e} | set(edges)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    want = {(v, min(u for u in {x for e in edges for x in e} if (u, v) in reach and (v, u) in reach)) for v in {x for e in edges for x in e}}
    df = spark.createDataFrame([*edges, edges[0], (None, 3)], "src long, dst long")
    found, between = graph.strong_components(df.where("src is not null"))
    assert _rows(graph.scc(df)) == want == _rows(found)
    of = dict(want)
    assert _rows(between) == {(of[a], of[b]) for a, b in reach}


def test_no_edges(spark):
    assert graph.scc(spark.createDataFrame([], "src long, dst long")).count() == 0
