
from grainstore.operators.references import EDGES, Edge, direct_orphans, orphan_cascade, orphan_report

T = "2024-01-01 00:00:00"


def _log(spark, rows=()):
    return spark.createDataFrame(list(rows), "table_name string, record_key string")


def _tables(spark, **rows):
    schemas = {
        "projects": "id long, created_at string", "threads": "id long, project_id long, created_at string", "turns": "id long, thread_id long, created_at string",
        "project_docs": "id long, project_id long, doc_id string, created_at string", "project_repos": "id long, repo_id string, created_at string",
        "uploads": "id long, kind string, target_id string, created_at string",
    }
    return {n: spark.createDataFrame(rows.get(n, []), s) for n, s in schemas.items()}


def test_reasons(spark):
    t = _tables(
        spark, projects=[(1, T), (1, "2023-01-01T00:00:00Z"), (2, "2025-01-01 00:00:00")],
        threads=[(10, 1, T), (11, 2, T), (12, 3, T), (13, 4, T), (14, None, T), (15, 1, "no time")],
        uploads=[(1, " DOC ", "d1", T), (2, "code", "d1", T), (3, None, "d1", T), (4, "doc", None, T)], project_docs=[(1, 1, "d1", T), (1, 1, "d1", T)],
    )
    found = {(r.src_table, r.row_id, r.reason) for r in direct_orphans(t, _log(spark, [("projects", "3"), ("threads", "4")])).collect()}
    assert found == {("threads", 11, "late"), ("threads", 12, "deleted"), ("threads", 13, "missing"), ("uploads", 2, "missing"), ("uploads", 3, "missing")}


def test_children_inherit(spark):
    t = _tables(spark, projects=[(1, T)], threads=[(10, 9, T), (11, 1, T)], turns=[(100, 10, T), (101, 11, T)])
    found = {(r.src_table, r.row_id, r.origin, r.depth) for r in orphan_cascade(t, _log(spark)).collect()}
    assert found == {("threads", 10, "direct", 0), ("turns", 100, "inherited", 1)}


def test_a_chain_of_21_is_followed_to_its_end(spark):
    n = 21
    edges = tuple(Edge(f"t{i}", "up", f"t{i - 1}", "id") for i in range(1, n + 1))
    tables = {f"t{i}": spark.createDataFrame([(1, 1 if i > 1 else 7, T)] if i else [(0, 0, T)], "id long, up long, created_at string") for i in range(n + 1)}
    found = orphan_cascade(tables, _log(spark), edges).collect()
    assert sorted(r.depth for r in found) == list(range(n))


def test_report_and_empty_tables(spark):
    empty = _tables(spark)
    assert orphan_cascade(empty, _log(spark)).count() == 0
    t = _tables(spark, threads=[(1, 5, "2024-01-31 23:30:00"), (2, 5, "2024-02-01T01:00:00+09:00"), (3, 5, None)])
    rows = {(r.src_table, r.month, r.n) for r in orphan_report(orphan_cascade(t, _log(spark), EDGES)).collect()}
    assert rows == {("threads", "2024-01", 2), ("threads", None, 1)}
