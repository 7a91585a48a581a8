"""The entry points hold with and without the training-data subpackage."""

import sys

import pytest

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and {"mr_all", "under_pairs", "on_demand"} <= set(queries)


def test_without_the_subpackage(monkeypatch):
    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert not any(name.startswith("op") and name[2].isdigit() for name in entry.queries()) and "pipeline" not in entry.queries()


@pytest.mark.parametrize("missing", ["regex", "weft.llm", "weft.llm.registry"])
def test_without_something_the_subpackage_needs(monkeypatch, missing):
    """The engine's queries stay where the subpackage or a package of its can't be imported."""
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("weft.llm")]:
        monkeypatch.delitem(sys.modules, name)
    if "weft.llm" in dir(__import__("weft")):
        monkeypatch.delattr("weft.llm")
    monkeypatch.setitem(sys.modules, missing, None)
    assert "mr_all" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert "pipeline" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
