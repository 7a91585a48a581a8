"""DataFrame operators against the kernel and by hand; both strategies against each other."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_kernel import CHAIN, random_graph
from weft import cli
from weft.functions.labels import LabelFormat, classify, masked, paired, ranked
from weft.operators import graph
from weft.operators.components import connected_components
from weft.plans import analyses, fixpoint, kernel
from weft.plans.languages import METHODS, UNION, Language, excluding
from weft.schema import EDGES, PAIRS
from weft.sources import edge_list


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), EDGES)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_classify(spark):
    raw = spark.createDataFrame(
        [(1, 2, "op_i", 3), (1, 2, "op_i", 3), (2, 3, "cp_i", 3), (3, 4, "normal", None), (4, 5, "xb_i", 1), (5, 6, "odd", 1), (None, 1, "normal", None), (7, 8, "ob_i", None)],
        "src long, dst long, label string, index int",
    )
    assert rows(classify(raw)) == {(1, 2, "p", "o", 3), (2, 3, "p", "c", 3), (3, 4, "n", "n", 0), (4, 5, "b", "o", 1)}
    own = LabelFormat(lambda c: F.when(c == "odd", "b"), lambda c: F.lit("c"))
    assert rows(classify(raw, own)) == {(5, 6, "b", "c", 1)}


def test_halves_ranks_masks(spark):
    edges = {(0, 1, "p", "o", 5), (1, 2, "p", "c", 5), (2, 3, "p", "o", 9), (3, 4, "b", "o", 7), (4, 5, "b", "c", 7), (5, 6, "n", "n", 0), (0, 3, "b", "o", 8), (1, 3, "b", "c", 8)}
    df = frame(spark, edges)
    assert rows(paired(df)) == kernel.paired(edges)
    assert {(r["family"], r["label"], r["rank"]) for r in ranked(df).collect()} == {("p", 5, 0), ("p", 9, 1), ("b", 7, 0), ("b", 8, 1), ("n", 0, 0)}
    assert {(r["label"], r["mask"]) for r in masked(df, Language("p", 2)).collect() if r["family"] == "b"} == {(7, 1), (8, 2)}
    assert {(r["label"], r["mask"]) for r in masked(df, excluding(0)).collect() if r["family"] == "b"} == {(7, 0), (8, 2)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (2, 1), (2, 3)] + [(k, k + 1) for k in range(100, 160)]
    got = rows(connected_components(spark.createDataFrame(edges, PAIRS)))
    assert got == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (5, 5)} | {(k, 100) for k in range(100, 161)}
    assert connected_components(spark.createDataFrame([], PAIRS)).count() == 0
    assert rows(connected_components(spark.createDataFrame(edges, PAIRS), one_task=1000)) == got
    assert connected_components(spark.createDataFrame([], PAIRS), one_task=1000).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_operators_match_the_kernel(spark, seed):
    rng = random.Random(seed)
    edges = random_graph(rng, 12, 22)
    df = frame(spark, edges)
    reach = kernel.Reach(edges)
    vertices = {v for e in edges for v in e[:2]}
    closed = {(u, v) for u in vertices for v in reach.from_(u)}
    assert rows(graph.closure(df)) == closed
    scc, between = graph.strong_components(df)
    low = {u: min(v for v in vertices if (u, v) in closed and (v, u) in closed) for u in vertices}
    assert rows(scc) == set(low.items()) and rows(between) == {(low[a], low[b]) for a, b in closed}
    pairs = set(rng.sample(sorted(closed), 3)) | {(0, 11)}
    pf = spark.createDataFrame(sorted(pairs), PAIRS)
    assert rows(graph.relevant(df, pf)) == kernel.relevant(edges, pairs)
    assert rows(graph.value_flow_edges(df)) == kernel.value_flow_edges(edges)
    every = {(u, v) for u, v in closed if u != v}
    assert rows(graph.bracket_pairs(df, spark.createDataFrame(sorted(every), PAIRS))) == kernel.bracket_pairs(edges, every)
    rep = kernel.representatives(every)
    rf = graph.representatives(spark.createDataFrame(sorted(every), PAIRS))
    assert dict(rows(rf)) == rep
    assert rows(graph.condense(df, rf)) == kernel.condense(edges, rep)
    small = {(low[a], low[b]) for a, b in pairs}
    members = {r: [v for v, x in rep.items() if x == r] for r in rep.values()}
    want = kernel.expand(small, rep) | {(u, v) for own in members.values() for u in own for v in own if u != v}
    assert rows(graph.expand(spark.createDataFrame(sorted(small), PAIRS), rf)) == want
    assert rows(graph.push(pf, rf)) == {(rep.get(a, a), rep.get(b, b)) for a, b in pairs}
    assert rows(graph.adjacency(df)) == {e[:2] for e in edges}


def test_pair_sets(spark):
    a, b = (spark.createDataFrame(x, PAIRS) for x in ([(1, 1), (1, 2), (2, 3)], [(1, 2), (3, 2), (1, 2)]))
    assert rows(graph.non_trivial(a)) == {(1, 2), (2, 3)} and rows(graph.intersection(a, b)) == {(1, 2)}
    assert rows(graph.difference(a, b)) == {(1, 1), (2, 3)} and rows(graph.union(a, b)) == {(1, 1), (1, 2), (2, 3), (3, 2)}
    assert rows(graph.transposed(b)) == {(2, 1), (2, 3)}


@pytest.mark.parametrize("language", [UNION, Language("p", 2, True), Language("b", 1), excluding(0)], ids=str)
def test_relational_facts_match_the_kernel(spark, language):
    edges = random_graph(random.Random(5), 6, 11)
    parts = kernel.components(edges)
    df = frame(spark, edges)
    assert rows(analyses.language_pairs(df, language, "relational")) == {p for own in parts for p in kernel.Solver(own, language).reach()} == rows(analyses.language_pairs(df, language))
    useful = {e for own in parts for e in kernel.Solver(own, language).useful()}
    assert rows(analyses.useful_edges(df, language, "relational")) == useful == rows(analyses.useful_edges(df, language))


#: A ring with branches and several labels a family; over and under differ on it, the methods among themselves don't.
TANGLE = {
    (0, 1, "p", "o", 1), (1, 2, "b", "o", 1), (2, 3, "p", "c", 1), (3, 4, "b", "c", 1), (1, 3, "b", "o", 2), (3, 0, "b", "c", 2), (0, 2, "n", "n", 0), (2, 1, "p", "o", 2), (4, 1, "p", "c", 2),
}


@pytest.mark.parametrize("method", ["parity2", "all"])
def test_relational_refinement_matches_the_kernel(spark, method):
    edges = kernel.paired({*CHAIN, *((a + 30, b + 30, *e) for a, b, *e in TANGLE)})
    df = frame(spark, edges)
    assert rows(analyses.under_approximation(df, strategy="relational")) == kernel.under(edges)
    assert rows(analyses.over_approximation(df, method, strategy="relational")) == kernel.over(edges, method)


def test_relational_value_flow_matches_the_kernel(spark):
    edges = kernel.paired(TANGLE)
    df = frame(spark, edges)
    assert rows(analyses.under_approximation(df, True, "relational")) == kernel.under(edges, True)
    assert rows(analyses.over_approximation(df, "parity", None, True, "relational")) == kernel.over(edges, "parity", None, True)


@pytest.mark.parametrize("parity_d", [True, False])
def test_on_demand_in_all_ways(spark, parity_d):
    """Whole components, dealt pairs and joins give what the kernel gives."""
    edges = kernel.paired({*CHAIN, *((a + 30, b + 30, *e) for a, b, *e in TANGLE)})
    low, high = kernel.under(edges), kernel.over(edges, "parity")
    want = kernel.on_demand(edges, low, high, parity_d)
    assert low <= want <= high
    df, lf, hf = (spark.createDataFrame(sorted(x), s) for x, s in ((edges, EDGES), (low, PAIRS), (high, PAIRS)))
    assert rows(analyses.on_demand(df, lf, hf, parity_d)) == want
    assert rows(analyses.on_demand(df, lf, hf, parity_d, together=3)) == want
    if parity_d:
        assert rows(analyses.on_demand(df, lf, hf, parity_d, strategy="relational")) == want


def test_files_and_report(spark, tmp_path):
    lines = ["0 5 op_i 1", "5  6\tob_i 1", "6 7 cb_i 1", "7 8 cp_i 1", "8 9 cp_i 2", "", "x y z", "8 8 normal"]
    path = tmp_path / "small.v1.g"
    path.write_text("\n".join(lines))
    assert rows(edge_list.read_edges(spark, str(path))) == set(CHAIN) | {(8, 8, "n", "n", 0)}
    assert edge_list.output_path(str(path), str(tmp_path / "out")).endswith("out/small.v1.out")
    options = cli.parse([str(path), "parityD"])
    text = cli.report(spark, options)
    assert text[0] == "Under approximation paths: 2" and text[4] == "On-Demand paths (parityD): 2" and text[5:] == ["\t0 8", "\t5 7"]
    assert len(cli.report(spark, cli.parse(["-q", str(path), "se"]))) == 3


def test_arguments():
    assert cli.parse(["-o", "d", "-valueflow", "g", "on-demand"]) | {} == {"graph": "g", "method": "all", "dir": "d", "quiet": False, "valueflow": True, "on_demand": True, "parity_d": False, "help": False}
    for bad in ([], ["g"], ["g", "odd"], ["g", "se", "x"], ["-o"]):
        with pytest.raises(ValueError):
            cli.parse(bad)
    assert cli.parse(["-h"])["help"]


def test_stream(spark, tmp_path):
    from weft.streaming.edges import append_edges, stream_edges

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.g").write_text("1 2 op_i 1\n1 2 op_i 1\n2 3 normal\n")
    append_edges(stream_edges(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == {(1, 2, "p", "o", 1), (2, 3, "n", "n", 0)}
