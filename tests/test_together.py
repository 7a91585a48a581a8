"""Queries that compare pairs within a component: components are found once, and no pair is shuffled."""

import pytest

from tests.test_memo import copies, many, rows  # noqa: F401
from tests.test_methods import EDGE, SEEDS, tangle
from weft.operators import graph
from weft.plans import analyses
from weft.plans.languages import ERASED, Language
from weft.session import materialise

P, B = Language("p"), Language("b")


def test_pairs_are_compared_within_components(many):  # noqa: F811
    apart = [rows(analyses.language_pairs(many, language)) for language in (P, B, ERASED)]
    under = rows(analyses.under_approximation(many))
    assert rows(analyses.unknown_pairs(many, P)) == apart[0] - under
    assert rows(analyses.common_pairs(many, [P, B, ERASED])) == set.intersection(*apart)


def test_components_are_found_once(many, monkeypatch):  # noqa: F811
    found = []
    split = graph.split
    monkeypatch.setattr(graph, "split", lambda edges: found.append(1) or split(edges))
    for run in (lambda e: analyses.unknown_pairs(e, P), lambda e: analyses.common_pairs(e, [P, B]), lambda e: analyses.over_condensed(e, "parity2", equal_once=True)):
        found.clear()
        run(many).count()
        assert len(found) == 1


@pytest.mark.parametrize("seed", SEEDS[:2])
def test_condensed_at_once_is_condensed_after(spark, seed):
    edges = materialise(spark.createDataFrame(sorted(tangle(seed)), EDGE))
    known = materialise(analyses.under_approximation(edges))
    want = rows(analyses.over_approximation(edges, "parity2", known))
    assert rows(analyses.over_condensed(edges, "parity2")) == rows(analyses.over_condensed(edges, "parity2", equal_once=True)) == want


def test_a_half_in_another_component_keeps_its_label(spark):
    # the label 1 opens in one component and closes in the other: it keeps rank 1 from becoming rank 0
    edges = {(1, 2, "b", "o", 0), (2, 3, "b", "o", 1), (3, 4, "b", "c", 0), (11, 12, "b", "c", 1), (12, 13, "p", "o", 0), (13, 14, "p", "c", 0)}
    frame = materialise(spark.createDataFrame(sorted(edges), EDGE))
    known = materialise(analyses.under_approximation(frame))
    for method in ("default", "parity", "parity2", "all"):
        assert rows(analyses.over_condensed(frame, method)) == rows(analyses.over_approximation(frame, method, known))


def test_large_components_are_compared_by_blocks(spark):
    edges = materialise(spark.createDataFrame(sorted(tangle(SEEDS[0])), EDGE))
    assert rows(analyses.common_pairs(edges, [P, B], largest=1)) == rows(analyses.common_pairs(edges, [P, B]))
