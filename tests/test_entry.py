import sys

import pytest

import __spark_entry__ as e


def test_without_llm_the_general_queries_remain(monkeypatch):
    monkeypatch.setitem(sys.modules, "grainstore.llm.queries", None)
    with pytest.warns(UserWarning) if e.importlib.util.find_spec("grainstore.llm") else _nothing():
        names = e.queries()
    assert {"hybrid_search", "p6_found", "rerank", "scope_filter", "repo_relations"} <= set(names)


class _nothing:
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def test_each_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_gives_rows(spark):
    df = e.entry(spark)
    assert {"question_id", "position", "kind", "score", "context_line"} <= set(df.columns)
    assert df.count() > 0
