"""Components united where edges lie, and what that leaves to the rounds of joins."""

import random

import pytest

from tests.test_kernel import random_graph
from weft.operators import components, graph
from weft.plans import kernel
from weft.schema import EDGES
from weft.session import materialise
from weft.sources.tables import event_graph, woven_graph

SF = "/root/testdata/sf0.01"


def of_kernel(edges):
    return {(*e, min(v for x in part for v in x[:2])) for part in kernel.components(edges) for e in part}


@pytest.mark.parametrize("chunk", [3, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_split_is_the_kernels(spark, monkeypatch, seed, chunk):
    rng = random.Random(seed)
    edges = set().union(*({(u + 50 * k, v + 50 * k, *rest) for u, v, *rest in random_graph(rng, 12, 10)} for k in range(6)))
    edges |= {(7, 7, "n", "n", 0), (900, 900, "n", "n", 0)}
    shuffled = sorted(edges)
    rng.shuffle(shuffled)
    monkeypatch.setattr(graph, "united", lambda e: components.united(e, chunk=chunk))
    df = spark.createDataFrame(shuffled, EDGES).repartition(3)
    assert {tuple(r) for r in graph.split(df).collect()} == of_kernel(edges)
    got = {tuple(r) for r in graph.weak_components(df).collect()}
    assert got == {tuple(r) for r in components.connected_components(df).collect()}
    assert graph.split(df.limit(0)).count() == graph.weak_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("source", [event_graph, woven_graph])
def test_rounds_see_no_edge_of_chains_that_lie_together(spark, monkeypatch, source):
    edges = materialise(source(spark, SF))
    want = of_kernel({tuple(r) for r in edges.collect()})
    seen = []

    def rounds(links, *args, **kw):
        seen.append(links.count())
        return found(links, *args, **kw)

    found = components.connected_components
    monkeypatch.setattr(components, "connected_components", rounds)
    monkeypatch.setattr(graph, "connected_components", rounds)
    got = [tuple(r) for r in graph.split(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(seen) < len({e[-1] for e in want}) / 10
