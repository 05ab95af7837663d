"""Every query against its SQL, and the contract of the entry module."""

import sys

import pytest
from compare import check

from jobs import queries as jobs
from lexigrade.plans import catalog

QUICK = sorted(catalog.ORACLES)


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, sf, name):
    check(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.queries()) >= set(catalog.QUERIES) | set(jobs.QUERIES) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["item_id", "doc_id", "rank", "score"]


def test_entry_without_llm(monkeypatch):
    """The other queries work when the llm subpackage and the pipeline are gone."""
    for name in [m for m in sys.modules if m.startswith("lexigrade.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "lexigrade.llm", None)
    import __spark_entry__ as e

    assert set(e.queries()) == set(catalog.QUERIES) | set(jobs.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
