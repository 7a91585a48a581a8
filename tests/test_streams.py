"""Components as one stream, and on-demand questions under the memo."""

import pytest

from tests.test_memo import copies, many, rows  # noqa: F401
from weft.operators import graph
from weft.plans import analyses, kernel
from weft.session import materialise


@pytest.fixture()
def short_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def test_batches_end_within_components(many, short_batches):  # noqa: F811
    got = rows(analyses.under_approximation(many))
    assert got == kernel.under(copies())
    assert rows(analyses.bracket_pairs(many, analyses.under_approximation(many))) == kernel.bracket_pairs(copies(), got)


@pytest.mark.parametrize("parity_d", [False, True])
def test_on_demand_decides_each_shape_once(spark, many, parity_d):  # noqa: F811
    under, upper = (materialise(f) for f in (analyses.under_approximation(many), analyses.over_approximation(many, "parity")))
    want = set()
    for part in kernel.components(copies()):
        inside = {v for e in part for v in e[:2]}
        of = [{p for p in found if p[0] in inside} for found in (rows(under), rows(upper))]
        want |= kernel.on_demand(part, *of, parity_d)
    assert rows(analyses.on_demand(many, under, upper, parity_d, equal_once=True)) == want


def test_a_result_goes_where_members_are(many):  # noqa: F811
    from weft.plans import memo

    seen = many.sparkSession.sparkContext.accumulator(0)

    def run(own):
        seen.add(len(own))
        return [e[:2] for e in own]

    assert {tuple(r) for r in memo.once(graph.split(many), run).collect()} == {e[:2] for e in copies()}
    assert seen.value < len(copies())
