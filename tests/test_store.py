from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threadloom.operators import reconcile, snapshot
from threadloom.sources import readers, store
from threadloom.sources.store import SnapshotStore
from threadloom.streaming import incremental


def test_a_failed_publish_keeps_the_old_batch(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    with pytest.raises(LookupError):
        store.read("edges")
    store.publish({"edges": rows(("a", 1))}, {"edges": ["k"]}, "one")
    with pytest.raises(ValueError):
        store.publish({"edges": rows(("b", 1), ("b", 2))}, {"edges": ["k"]}, "two")
    with pytest.raises(ValueError):
        store.publish({"edges": rows((None, 1))}, {"edges": ["k"]}, "three")
    assert store.active() == "one" and store.read("edges").first()["k"] == "a"
    store.publish({"edges": rows().limit(0) if False else spark.createDataFrame([], "k string, v int")}, {"edges": ["k"]}, "four")
    assert store.active() == "four" and store.read("edges").count() == 0  # empty isn't missing


def test_rows_are_carried_over_unless_declared_gone(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    df = lambda *x: spark.createDataFrame(list(x), "scope string, k string")
    store.publish({"t": df(("a", "1"), ("a", "2"), ("b", "3"))}, {"t": ["k"]})
    scope = spark.createDataFrame([("a",)], "scope string")
    new = df(("a", "1"))
    assert {r["k"] for r in store.carried_over("t", new, ["k"], scope, ["scope"], complete=True).collect()} == {"1", "3"}
    assert {r["k"] for r in store.carried_over("t", new, ["k"], scope, ["scope"], complete=False).collect()} == {"1", "2", "3"}


def test_incomplete_snapshots_delete_nothing(spark):
    current = spark.createDataFrame([("e", "p", "x", "1"), ("e", "p", "n", None)], "environment string, profile string, program string, hash string")
    previous = spark.createDataFrame([("e", "p", "x", "1", "v"), ("e", "p", "gone", "2", "v"), ("e", "p", "n", None, "v")], "environment string, profile string, program string, hash string, version string")
    plan = lambda complete: {r["program"]: r["action"] for r in snapshot.incremental_plan(current, previous, "v", complete).collect()}
    assert plan(False) == {"x": "UNCHANGED", "n": "CHANGED"}  # a missing hash proves nothing
    assert plan(True) == {"x": "UNCHANGED", "n": "CHANGED", "gone": "DELETED"}
    assert snapshot.stale_versions(previous, "v2", current.where("1 = 0")).count() == 1


def test_stale_suppressions_bring_nothing_back(spark):
    rows = spark.createDataFrame([("e", "t", "a", "SQL_ONLY"), ("e", "t", "b", "MATCH")], "environment string, target string, source string, status string")
    keys = spark.createDataFrame([("e", "t", "a"), ("e", "t", "b"), ("e", "x", "y")], "environment string, target string, source string")
    got = {(r["source"], r["status"]) for r in reconcile.apply_suppressions(rows, keys).collect()}
    assert got == {("a", "SUPPRESSED"), ("b", "MATCH")}


def test_streamed_states(spark, tmp_path):
    schema = "environment string, profile string, program string, hash string, observed_at string"
    folder, root = f"{tmp_path}/in", f"file://{tmp_path}/store"
    add = lambda *x: spark.createDataFrame(list(x), schema).coalesce(1).write.mode("append").json(folder)
    go = lambda: incremental.start(spark.readStream.schema(schema).json(folder), root, f"{tmp_path}/cp", "v1").awaitTermination()
    add(("e", "p", "a", "1", "2024-01-01 00:00:00"), ("e", "p", "b", "1", "2024-01-01 00:00:00"))
    go()
    add(("e", "p", "a", "2", "2024-01-02 00:00:00"), ("e", "p", "c", "1", "2024-01-02 00:00:00"))
    go()
    rows = SnapshotStore(spark, root).read("states").select("program", "hash", F.col("first_seen").cast("string"), F.col("last_changed").cast("string")).collect()
    day = lambda d: f"2024-01-0{d} 00:00:00"
    assert {tuple(r) for r in rows} == {("a", "2", day(1), day(2)), ("b", "1", day(1), day(1)), ("c", "1", day(2), day(2))}


def test_readers(spark, tmp_path):
    base = tmp_path / "P" / "1.0" / "DWS_DWF" / "DWS_DWF.F_X"
    base.mkdir(parents=True)
    (base / "a.py").write_bytes("x = '中'".encode("gbk"))
    (base / "b.txt").write_text("no")
    (tmp_path / "P" / "c.py").write_text("short")
    files = readers.scan_working_copy(spark, f"{tmp_path}/P")
    got = {r["path"].rpartition("/")[2]: (r["layer"], r["target"], r["reason"], r["text"]) for r in files.collect()}
    assert got["a.py"] == ("DWF", "DWF.F_X", None, "x = '中'") and got["b.txt"][2] == "NOT_A_PROGRAM" and got["c.py"][3] is None
    assert {(r["layer"], r["status"]) for r in readers.inventory(files).collect()} == {("DWF", "COMPLETE"), (None, "PARTIAL")}
    rows = spark.createDataFrame([("p", "k", "dwd.a", "dwf.t"), ("p", "k", "dwd.a", "dwf.t"), ("p", "z", "dwd.a", "dwf.t"), ("p", "k", "a", "dwf.t")], "process_name string, project string, source_table string, target_table string")
    scope = readers.schedule_scope(F.col("project"), F.col("target_table"), ["k"], [("z", "dwm.")])
    edges, counters = readers.schedule_edges(rows, "PROD", scope)
    assert edges.count() == 1 and {tuple(r) for r in counters.collect()} == {(None, 2), ("OUT_OF_SCOPE", 1), ("SOURCE", 1)}
    (tmp_path / "x.txt").write_text("a, b,c\nd\n")
    assert [tuple(r) for r in readers.two_columns(spark, f"{tmp_path}/x.txt", ("k", "v")).collect()] == [("a", "b,c"), ("d", None)]
    (tmp_path / "m.json").write_text('[{"a": "1", "b": "2"}]')
    assert readers.json_snapshot(spark, f"{tmp_path}/m.json", "a string, b string", ["a"]).first()["b"] == "2"
    facts = spark.createDataFrame([("x", 1)], "batch_id string, v int")
    batches = spark.createDataFrame([("y", True), ("x", False)], "batch_id string, is_active boolean")
    assert [tuple(r) for r in readers.active_rows(facts, batches).collect()] == [("y", None)]
    sources = readers.program_sources(spark.createDataFrame([(" n ", "code", "dwf.t"), (None, "c", None), ("m", None, None)], "name string, code string, target string"), "PROD", "P", "name", "code", "target")
    assert [(r["program_name"], r["expected_target"], len(r["source_hash"])) for r in sources.collect()] == [("n", "DWF.T", 64)]


def test_copies_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    store.copy_table(rows, spark, "copied")
    store.copy_table(rows.where("k = 2"), spark, "copied")
    assert [tuple(r) for r in spark.table("copied").collect()] == [(2, None)]
    with pytest.raises(ValueError):
        store.copy_table(rows.select("k"), spark, "copied")
    spark.sql("drop table copied")
