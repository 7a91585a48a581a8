"""The memo of components: shapes, and results equal to those of components solved one by one."""

import duckdb
import pytest

from tests.test_methods import EDGE, SEEDS, tangle
from weft import queries
from weft.operators import graph
from weft.plans import analyses, memo
from weft.plans.languages import METHODS, Language
from weft.session import materialise

SF = "/root/testdata/sf0.01"


def shifted(edges, by, name):
    """The same component under other ids that keep their order."""
    return {(by + 3 * u, by + 3 * v, f, s, 0 if f == "n" else name + 5 * label) for u, v, f, s, label in edges}


def copies():
    """Each tangle three times under other ids, one of them mirrored (other order of ids, another shape)."""
    out, n = set(), 0
    for seed in SEEDS:
        edges = tangle(seed)
        for name in (0, 7, 100):
            out |= shifted(edges, n, name)
            n += 100
        out |= {(n + 20 - u, n + 20 - v, *rest) for u, v, *rest in edges}
        n += 100
    return out


@pytest.fixture(scope="module")
def many(spark):
    return materialise(spark.createDataFrame(sorted(copies()), EDGE))


def rows(frame):
    got = [tuple(r) for r in frame.select("src", "dst").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_shapes_are_those_of_equal_components(many):
    shaped = memo.shapes(graph.split(many))
    counts = [r.n for r in shaped.groupBy("digest").agg({"*": "count"}).toDF("digest", "n").collect()]
    assert sum(counts) == shaped.count() and sum(n >= 3 for n in counts) >= len(SEEDS)
    for row in shaped.collect():
        own = {e for e in copies() if e[0] in row.vertices}
        back = {(row.vertices[u - 1], row.vertices[v - 1], f, s) for u, v, f, s, _ in memo._edges(row.shape)}
        assert back == {e[:4] for e in own} and len(memo._edges(row.shape)) == len(own)


@pytest.mark.parametrize("method", METHODS)
def test_over_is_that_of_single_components(many, method):
    assert rows(analyses.over_approximation(many, method, equal_once=True)) == rows(analyses.over_approximation(many, method))


@pytest.mark.parametrize("valueflow", [False, True])
def test_under_is_that_of_single_components(many, valueflow):
    assert rows(analyses.under_approximation(many, valueflow, equal_once=True)) == rows(analyses.under_approximation(many, valueflow))


def test_language_with_repeated_rows_and_other_columns(spark, many):
    from pyspark.sql import functions as F

    noisy = many.union(many).withColumns({"digest": F.lit("x"), "shape": F.lit(1), "vertices": F.lit(2), "salt": F.lit(3)})
    language = Language("b", 2, True)
    assert rows(analyses.language_pairs(noisy, language, equal_once=True)) == rows(analyses.language_pairs(many, language))


def test_each_shape_is_solved_once(spark, many):
    tried = spark.sparkContext.accumulator(0)

    def run(own):
        tried.add(1)
        return analyses._frame((u, v) for u, v, *_ in own)

    got = rows(memo.once(graph.split(many), run).distinct())
    assert got == rows(many.where("src <> dst").union(graph.split(many).where("src = dst").select(many.columns)).distinct().select("src", "dst").distinct())
    assert tried.value == memo.shapes(graph.split(many)).select("digest").distinct().count() < len(SEEDS) * 4


def test_no_edges(spark):
    assert rows(analyses.over_approximation(spark.createDataFrame([], EDGE), "all", equal_once=True)) == set()


@pytest.mark.parametrize("name", ["memo_shapes", "memo_under", "memo_all"])
def test_query_is_the_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in queries.queries()[name](spark, SF).select(columns).collect()]
    assert sorted(got) == sorted(want.fetchall()) and got
    if name == "memo_shapes":
        assert len(got) < sum(r[columns.index("n_components")] for r in got)
