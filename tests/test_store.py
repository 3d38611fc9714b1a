from pyspark.sql import functions as F

from grainstore.operators import store


def _tables(spark):
    make = lambda rows, name: spark.createDataFrame(rows, store.SCHEMAS[name])
    t = "2024-01-01 00:00:00"
    return {
        "projects": make([(1, "a", t), (2, "b", t)], "projects"),
        "threads": make([(10, 1, "x", "general", t, t), (20, 2, "y", "general", t, t), (30, None, "z", None, t, None)], "threads"),
        "turns": make([(100, 10, "user", "q", None, t), (200, 20, "user", "q", None, t), (300, None, "user", "q", None, t)], "turns"),
        "project_docs": make([(1, 1, "f", None, 0, "h", "d1", "p/d1", t), (2, 2, "f", None, 0, "h", "d1", "p/d1", t), (3, 1, "g", None, 0, "i", "d2", "p/d2", t)], "project_docs"),
        "project_repos": make([(1, 1, "f", "h", "r1", "z/r1", "x/r1", t)], "project_repos"),
        "project_targets": make([(1, "doc", "d1", "f", t), (2, "doc", "d1", "f", t)], "project_targets"),
        "project_target_settings": make([(1, 1, t)], "project_target_settings"),
    }


def test_delete_projects_spares_shared_files(spark):
    left = store.delete_projects(_tables(spark), spark.createDataFrame([(1,)], "project_id long"))
    assert [r.id for r in left["projects"].collect()] == [2]
    assert {r.id for r in left["threads"].collect()} == {20, 30}
    assert {r.id for r in left["turns"].collect()} == {200, 300}
    assert {r.path for r in left["files"].collect()} == {"p/d2", "z/r1", "x/r1"}  # p/d1 is the other project's too
    assert left["project_targets"].count() == 1 and left["project_target_settings"].count() == 0


def test_upsert_takes_the_latest(spark):
    old = _tables(spark)["project_targets"]
    new = spark.createDataFrame([(1, "doc", "d1", "late", "2024-03-01 00:00:00"), (1, "doc", "d1", "early", "2024-02-01 00:00:00"), (3, "code", "r", "new", None)], old.schema)
    out = {(r.project_id, r.filename) for r in store.upsert(old, new, ["project_id", "target_kind", "target_ref_id"]).collect()}
    assert out == {(1, "late"), (2, "f"), (3, "new")}


def test_insert_if_absent(spark):
    old = _tables(spark)["projects"]
    new = spark.createDataFrame([(7, "a", None), (8, "c", None), (9, "c", None)], old.schema)
    assert sorted(r.name for r in store.insert_if_absent(old, new, ["name"]).collect()) == ["a", "b", "c"]


def test_add_turns_touches_the_thread_only_forward(spark):
    t = _tables(spark)
    new = spark.createDataFrame(
        [(101, 10, "user", "q", None, "2024-02-01T00:00:00+09:00"), (201, 20, "user", "q", None, "2023-01-01 00:00:00"), (301, 30, "user", "q", None, "2023-01-01 00:00:00")],
        store.SCHEMAS["turns"],
    )
    out = store.add_turns(t, new)
    assert out["turns"].count() == 6
    assert {r.id: r.updated_at for r in out["threads"].collect()} == {10: "2024-02-01T00:00:00+09:00", 20: "2024-01-01 00:00:00", 30: "2023-01-01 00:00:00"}


def test_delete_threads_and_empty_tables(spark):
    out = store.delete_threads(_tables(spark), spark.createDataFrame([(10,)], "thread_id long"))
    assert {r.id for r in out["threads"].collect()} == {20, 30} and {r.id for r in out["turns"].collect()} == {200, 300}
    empty = store.empty_tables(spark)
    assert set(empty) == set(store.SCHEMAS) and all(df.count() == 0 for df in store.delete_projects(empty, spark.createDataFrame([(1,)], "project_id long")).values())


def test_scope(spark):
    assets = spark.createDataFrame([(1, "doc", "d1"), (1, "doc", "d2"), (1, "code", "r1"), (2, "doc", "d1"), (3, "doc", "d3")], "project_id long, kind string, ref_id string")
    targets = spark.createDataFrame([(1, "doc", "d1"), (2, "doc", "zz")], "project_id long, target_kind string, target_ref_id string")
    settings = spark.createDataFrame([(1, 1), (2, 0)], "project_id long, active_only int")
    out = {(r.project_id, r.ref_id) for r in store.active_assets(assets, targets, settings).collect()}
    assert out == {(1, "d1"), (2, "d1"), (3, "d3")}  # without settings all assets count
    chunks = spark.createDataFrame([("doc", "d1", "c1"), ("code", "d1", "c2")], "kind string, ref_id string, chunk_id string")
    assert [r.chunk_id for r in store.in_scope(chunks, assets).collect()] == ["c1"]
    assert store.in_scope(chunks, assets.where("false")).count() == 0


def test_search_listing_payload_and_lines(spark):
    threads = spark.createDataFrame([(1, "Lease notes", None), (2, None, "lease"), (3, "x", "y")], "id long, title string, tag string")
    assert {r.id for r in store.thread_search(threads, "LEASE").collect()} == {1, 2}
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01T09:00:00+09:00"), (3, None)], "id long, created_at string")
    assert [r.id for r in store.listing(rows, "created_at").orderBy("position").collect()] == [2, 1, 3]
    assert store.listing(rows, "created_at", limit=1).count() == 1
    turns = spark.createDataFrame([(1, 5, "assistant", '{"a":1}'), (2, 5, "assistant", "{bad"), (3, 5, "user", '{"b":1}'), (4, 5, "assistant", "[1]")], "id long, thread_id long, role string, payload_json string")
    assert store.last_payload(turns).first().payload_json == '{"a":1}'
    line = spark.createDataFrame([("v", None)], "name string, b int").select(store.csv_lines(["name", "b"]).alias("x"))
    assert line.first().x == "name: v | b: "
    assert spark.range(1).select(store.thread_title(F.lit("x" * 50)).alias("t")).first().t == "x" * 40
