"""Cycle lists, column chains, stars, traces and layers against plain Python, and stores by what they read."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import audit, columns, cycles, metadata, reports, traces
from threadloom.sources import readers, store


def _plain_cycles(edges):
    out, adj = set(), {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)

    def walk(start, path):
        for b in adj.get(path[-1], ()):
            if b == start:
                out.add(tuple(path))
            elif b > start and b not in path:
                walk(start, [*path, b])

    for a in adj:
        walk(a, [a])
    return sorted(out, key=lambda c: (len(c), c))


def _lists(df):
    return [(r["component"], r["place"], tuple(r["cycle"]), r["more"]) for r in df.orderBy("component", "place").collect()]


@pytest.mark.parametrize("seed", [3])
def test_cycle_lists_match_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = []
    for part in range(4):  # sparse and dense graphs, and a ring with detours
        base, n = 100 * part, rng.choice((4, 7, 9))
        edges += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.choice((n, 2 * n)))]
    ring = [900 + k for k in rng.sample(range(30), 30)]
    edges += list(zip(ring, ring[1:] + ring[:1], strict=True)) + [(ring[3], 990), (990, 991), (991, ring[9]), (ring[12], ring[12])] + [(None, 1), (1, None)]
    df = spark.createDataFrame([*edges, *edges[:5]], "src int, dst int")
    want = _plain_cycles([e for e in edges if None not in e])
    parts = []  # cycles that share a node are of one component
    for c in want:
        met = [p for p in parts if any(set(c) & set(d) for d in p)]
        parts = [p for p in parts if p not in met] + [sorted([c, *(d for p in met for d in p)], key=lambda c: (len(c), c))]
    few = _lists(cycles.cycle_lists(df, most=3))
    assert few == sorted((min(n for c in p for n in c), k + 1, c, len(p) > 3) for p in parts for k, c in enumerate(p[:3])) and any(m for *_, m in few)
    some = set(rng.sample([n for e in edges if None not in e for n in e], 4))
    only = _lists(cycles.cycle_lists(df, most=10_000, only=spark.createDataFrame([(n,) for n in some], "node int")))
    assert sorted(c for _, _, c, _ in only) == sorted(c for c in want if some & set(c))


def test_cycles_of_graphs_without_any(spark):
    assert _lists(cycles.cycle_lists(spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int"))) == []
    assert _lists(cycles.cycle_lists(spark.createDataFrame([], "src int, dst int"))) == []
    assert _lists(cycles.cycle_lists(spark.createDataFrame([("a", "a")], "src string, dst string"))) == [("a", 1, ("a",), False)]


def test_issue_keys_by_scope(spark):
    rows = spark.createDataFrame([("CYCLE_DETECTED", ["b", "a", "b"]), ("CYCLE_DETECTED", ["a", "b"]), ("ORPHAN_BRANCH", None), ("ORPHAN_BRANCH", ["x"]), ("SELF_REFERENCE", None), ("OTHER", None)], "t string, c array<string>")
    key = lambda n, b: audit.issue_key(F.lit("DEV"), F.lit("f"), F.lit("P"), F.col("t"), node=F.lit(n), branch=F.lit(b), cycle=F.col("c"))
    a, b, c = ([r[0] for r in rows.select(key(*x)).collect()] for x in (("n1", "s1"), ("n2", "s1"), ("n1", "s2")))
    assert a[0] == a[1] == b[0] and a[2] == a[3] == b[2] != c[2] and a[4] != b[4] and a[4] == c[4] and a[5] == b[5] == c[5] and len(set(a)) == 4


DEFINED = "program string, table string, column string, source_table string, source_column string, state string"


def test_producer_chains(spark):
    rows = [
        *[("P", "i.a", f"c{k}", "i.a", f"c{k + 1}", "RESOLVED") for k in range(40)],
        ("Q", "i.a", "c40", "x.s", "f", "RESOLVED"),
        ("R", "i.a", "c40", "x.t", "g", "RESOLVED"),
        ("P", "i.r", "u", "i.r", "v", "RESOLVED"), ("P", "i.r", "v", "i.r", "u", "RESOLVED"), ("P", "i.r", "w", "i.r", "u", "RESOLVED"), ("P", "i.r", "w", "x.s", "f", "RESOLVED"),
        ("P", "i.s", "s", "i.s", "s", "RESOLVED"),
        ("P", "i.m", "m", "i.none", "m", "RESOLVED"),
        ("P", "i.n", "n", None, "q", "AMBIGUOUS"), ("P", "i.n", "o", "i.n", "n", "RESOLVED"), ("P", "i.n", "p", "i.n", "o", "RESOLVED"), ("P", "i.n", "p", "i.m", "m", "RESOLVED"),
        ("P", "i.k", "k", None, None, "RESOLVED"), ("P", None, "k", "x", "y", "RESOLVED"),
    ]
    got = columns.producer_chains(spark.createDataFrame(rows, DEFINED), lambda t: t.startswith("i.")).collect()
    by = {}
    for r in got:
        by.setdefault((r["table"], r["column"]), set()).add((r["state"], r["source_table"], r["source_column"], r["program"]))
    ends = {("RESOLVED", "x.s", "f", "Q"), ("RESOLVED", "x.t", "g", "R")}
    assert all(by["i.a", f"c{k}"] == ends for k in range(41))
    state = {k: {s for s, *_ in v} for k, v in by.items()}
    assert [state["i.r", c] for c in "uvw"] == [{"CYCLE"}] * 3 and state["i.s", "s"] == {"CYCLE"}
    assert state["i.m", "m"] == {"MISSING"} and [state["i.n", c] for c in "nop"] == [{"AMBIGUOUS"}] * 3 and state["i.k", "k"] == {"UNRESOLVED"} and len(by) == 50
    assert columns.producer_chains(spark.createDataFrame([], DEFINED), lambda t: t.startswith("i.")).count() == 0


def test_stars_are_written_out(spark):
    meta = spark.createDataFrame([("a", 1, "k"), ("a", 2, "x"), ("b", 1, "y"), ("b", 2, "K"), ("c", 1, "m"), ("c", 2, "k")], "table string, position int, column string")
    none = None
    rel = [
        (1, 1, "a", "a", none), (1, 2, "b", "b", ["K"]), (1, 3, "q", "c", ["k"]),  # one k of three
        (2, 1, "a", "a", []), (2, 2, "b", "b", []), (2, 3, "c", "c", ["k"]),  # k is on the left twice
        (3, 1, "a", "a", none), (3, 2, "z", "unknown", none),
        (4, 1, "a", "a", none), (4, 2, "b", "b", none),
        (5, 1, "a", "a", none), (5, 2, "b", "b", ["x"]),  # b has no x
    ]
    items = [(q, 1, none, "*", none) for q in (1, 2, 3, 5)] + [(1, 2, "Q", "*", none), (1, 3, none, "k", "kk"), (3, 2, "z", "*", none), (3, 3, "nobody", "*", none), (3, 4, "a", "x", none), (3, 5, none, "x", none), (4, 1, none, "k", none), (4, 2, "b", "k", none), (4, 3, none, "y", none), (4, 4, none, "nothing", none), (9, 1, none, "*", none)]
    df = columns.expand_stars(spark.createDataFrame(items, "query int, ordinal int, qualifier string, column string, alias string"), spark.createDataFrame(rel, "query int, place int, alias string, table string, using array<string>"), meta)
    got = {}
    for r in df.orderBy("position", "table").collect():
        got.setdefault(r["query"], []).append((r["position"], r["name"], r["table"], r["state"]))
    ok = "RESOLVED"
    assert got[1] == [(1, "K", "A", ok), (1, "K", "B", ok), (1, "K", "C", ok), (2, "X", "A", ok), (3, "Y", "B", ok), (4, "M", "C", ok), (5, "M", "C", ok), (6, "K", "C", ok), (7, "KK", "A", ok), (7, "KK", "B", ok), (7, "KK", "C", ok)]
    assert got[2] == [(1, "STAR_1", None, "AMBIGUOUS")] and got[5] == got[9] == [(1, "STAR_1", None, "UNRESOLVED")]
    assert got[3] == [(1, "STAR_1", None, "UNRESOLVED"), (2, "STAR_2", None, "UNRESOLVED"), (3, "STAR_3", None, "UNRESOLVED"), (4, "X", "A", ok), (5, "X", None, "UNRESOLVED")]
    assert got[4] == [(1, "K", None, "AMBIGUOUS"), (2, "K", "B", ok), (3, "Y", "B", ok), (4, "NOTHING", None, "UNRESOLVED")]


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_traces_over_jobs(spark):
    jobs = spark.createDataFrame([(j,) for j in "ABCDEFGH"], "job string")
    needs = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("B", "D"), ("D", "E"), ("E", "F"), ("A", "gone"), ("F", "G"), ("G", None)], "job string, dependency string")
    outputs = spark.createDataFrame([("A", "t.a"), ("B", "t.b"), ("C", "t.c"), ("E", "t.e"), ("E", "DWF.e"), ("F", "t.f"), ("gone", "t.x"), ("H", "t.h")], "job string, table string")
    terminal = lambda t: t.startswith("DWF.")
    t = traces.trace_jobs(jobs, needs, outputs, spark.createDataFrame([("t.a",), ("t.h",), ("t.none",)], "root string"), terminal)
    assert _rows(t.tables) == [("t.a", "DWF.e", 2), ("t.a", "t.a", 0), ("t.a", "t.b", 1), ("t.a", "t.c", 2), ("t.a", "t.e", 2), ("t.a", "t.f", 3), ("t.h", "t.h", 0)]
    assert _rows(t.ends) == [("t.a", "CYCLE", "A"), ("t.a", "MISSING", "gone"), ("t.a", "NATURAL", "t.f"), ("t.a", "STOP", "DWF.e"), ("t.a", "UNMAPPED", "D"), ("t.a", "UNMAPPED", "G"), ("t.h", "NATURAL", "t.h")]
    assert _rows(t.edges) == [("t.a", "DWF.e", "t.b", 2), ("t.a", "t.b", "t.a", 1), ("t.a", "t.c", "t.b", 2), ("t.a", "t.e", "t.b", 2), ("t.a", "t.f", "t.e", 3)]
    short = traces.trace_jobs(jobs, needs, outputs, spark.createDataFrame([("t.a",)], "root string"), terminal, max_depth=2)
    assert ("t.a", "DEPTH", "t.b") in _rows(short.ends) and ("t.a", "t.e", 2) not in _rows(short.tables)
    down = traces.trace_jobs(jobs, needs, outputs, spark.createDataFrame([("t.f",)], "root string"), direction="down")
    assert _rows(down.tables) == [("t.f", t, d) for t, d in (("DWF.e", 1), ("t.a", 3), ("t.b", 2), ("t.c", 4), ("t.e", 1), ("t.f", 0))]
    assert ("t.f", "CYCLE", "B") in _rows(down.ends)


PROGRAMS = "program string, target string, script string"


def test_texts_that_no_level_reaches_are_not_read(spark, monkeypatch):
    rows = [("p1", "dwm.a", "insert into dwm.a select * from dwm.b join dwf.x on 1=1"), ("p2", "dwm.b", "insert into dwm.b select * from dwm.c, 1"), ("p3", "DWM.B", "insert into dwm.b select 1 from dwm.a join dwm.b on 1=1"), ("p4", "dwm.c", "select 1"), ("p5", "dwm.other", "select 1 from dwm.secret"), ("p6", "dwf.x", "select 1 from dwo.y"), ("p7", "dwm.a", "select 1 from dwm.second")]
    read = spark.sparkContext.accumulator(0)
    sources = traces.sqltext.source_tables

    def counted(x):
        @F.udf("string")
        def touch(t):
            read.add(1)
            return t

        return sources(touch(x))

    monkeypatch.setattr(traces.sqltext, "source_tables", counted)
    t = traces.trace_programs(spark.createDataFrame(rows, PROGRAMS), spark.createDataFrame([("p1",)], "program string"), lambda x: x.startswith("DWF."))
    assert _rows(t.tables) == [("p1", "DWF.X", 1), ("p1", "DWM.A", 2), ("p1", "DWM.B", 1), ("p1", "DWM.C", 2), ("p1", "DWM.SECOND", 3)]
    assert read.value == 5  # p1, p2, p3, p4 and p7, each once
    assert {("p1", "STOP", "DWF.X"), ("p1", "NATURAL", "DWM.C"), ("p1", "NATURAL", "DWM.SECOND"), ("p1", "CYCLE", "DWM.B")} <= set(_rows(t.ends))
    assert not any(r[1:] == ("NATURAL", "DWF.X") for r in _rows(t.ends))


def test_schedule_traces_end(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("DWF.x", "b"), ("y", "DWF.x"), ("e", "c")], "src string, dst string")
    t = traces.trace_schedule(edges, spark.createDataFrame([("a",), ("DWF.x",)], "root string"), lambda x: x.startswith("DWF."))
    assert _rows(t.ends) == [("DWF.x", "NATURAL", "y"), ("a", "CYCLE", "a"), ("a", "NATURAL", "e"), ("a", "STOP", "DWF.x")]
    one = traces.trace_schedule(edges, spark.createDataFrame([("a",)], "root string"), lambda x: x.startswith("DWF."), max_depth=1)
    assert _rows(one.ends) == [("a", "DEPTH", "b")] and _rows(one.tables) == [("a", "a", 0), ("a", "b", 1)]


def test_layers(spark):
    programs = spark.createDataFrame([("p1", "r"), ("p2", "a"), ("p3", "a"), ("p4", "hidden"), ("p5", "b"), ("p6", "DWF.s")], "program string, target string")
    reads = spark.createDataFrame([("p1", "a"), ("p1", "r"), ("p1", "hidden"), ("p1", "DWF.s"), ("p2", "b"), ("p3", "hidden"), ("p5", "a"), ("p5", "DWF.u"), ("p6", "z")], "program string, source string")
    known = spark.createDataFrame([(t,) for t in ("a", "b", "z", "DWF.s", "DWF.t", "DWF.u")], "table string")
    times = spark.createDataFrame([("a", 50), ("b", 20), ("b", 30), ("DWF.s", 10)], "table string, seconds int")
    nodes, edges = traces.layered_graph(programs, reads, spark.createDataFrame([("r",)], "root string"), known, times, lambda t: t.startswith("DWF."))
    got = sorted((r["level"], r["place"], r["node"], r["kind"], r["seconds"], r["alert"]) for r in nodes.collect())
    assert got == [(0, 1, "r", "root_table", None, None), (1, 1, "p1", "process", None, None), (2, 1, "DWF.s", "source_table", 10, 2), (2, 2, "a", "table", 50, None), (3, 1, "p2", "process", 50, None), (4, 1, "b", "table", 20, None), (5, 1, "p5", "process", 20, None), (6, 1, "DWF.u", "source_table", 20, 1)]
    assert set(_rows(edges.select("source", "target"))) == {("p1", "r"), ("a", "p1"), ("DWF.s", "p1"), ("p2", "a"), ("b", "p2"), ("p5", "b"), ("a", "p5"), ("DWF.u", "p5")}


def test_patterns_of_any_length(spark):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choice("abcé") for _ in range(rng.choice((0, 1, 3, 30))))) for k in range(60)] + [(60, None)]
    patterns = ["a", "B", "ab", "bcÉ", "abca", "aaaaa", "cabcab", "zzzz", "", None, "é" * 7]
    got = metadata.containing(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    want = sorted((k, p.upper()) for k, t in texts for p in patterns if p and t is not None and p.upper() in t.upper())
    assert _rows(got) == want
    assert _rows(metadata.containing(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame([("",)], "pattern string"))) == []


def test_reports_that_are_no_xml(spark):
    rows = spark.createDataFrame([("a [1].cpt", None), ("[2].cpt", ""), ("[3].cpt", "no xml <"), ("[4].cpt", "<WorkBook><TableDataMap><TableData><Query>select 1 from with_me where x = (\n select 2) and d_date = date '2020-01-01'</Query></TableData></TableDataMap></WorkBook>")], "report string, xml string")
    got = _rows(reports.report_issues(rows).select("report", "rule"))
    assert got == sorted([("a [1].cpt", "NAME_WITH_BLANK"), *[(r, "NO_XML") for r in ("a [1].cpt", "[2].cpt", "[3].cpt")], *[("[4].cpt", r) for r in ("DATE_CONVERSION", "EQUALS_SUBQUERY", "HARDCODED_DATE", "SCHEMA_MISSING")]])


def test_suppressions_by_scope(spark, tmp_path):
    kept = store.SuppressionStore(spark, f"file://{tmp_path}/s", ["env"], ["note"])
    rows = lambda *r: spark.createDataFrame(r, "env string, row_key string, note string")
    scope = lambda *e: spark.createDataFrame([(x,) for x in e], "env string")
    assert kept.publish(rows(("a", "1", "x"), ("a", "2", "x"), ("b", "1", "x")), scope("a", "b"), "2024-01-01 00:00:00") == {"active": 3, "retired": 0, "active_before": 0}
    before = sorted(p.name for p in (tmp_path / "s" / "env=b").iterdir())
    assert kept.publish(rows(("a", "2", "y"), ("a", "3", "y")), scope("a"), "2024-01-02 00:00:00") == {"active": 2, "retired": 1, "active_before": 2}
    assert kept.publish(spark.createDataFrame([], "env string, row_key string, note string"), scope("a"), "2024-01-03 00:00:00") == {"active": 0, "retired": 2, "active_before": 2}
    assert kept.publish(rows(("a", "1", "z")), scope("a"), "2024-01-04 00:00:00") == {"active": 1, "retired": 0, "active_before": 0}
    assert sorted(p.name for p in (tmp_path / "s" / "env=b").iterdir()) == before  # the other scope's files weren't touched
    got = {(r["env"], r["row_key"]): (r["note"], r["active"], r["created_at"].day, r["updated_at"].day) for r in kept.read().collect()}
    assert got == {("a", "1"): ("z", True, 1, 4), ("a", "2"): ("y", False, 1, 3), ("a", "3"): ("y", False, 2, 3), ("b", "1"): ("x", True, 1, 1)}
    for bad in (rows(("b", "1", "x")), rows(("a", None, "x")), rows(("a", "1", "x"), ("a", "1", "y"))):
        with pytest.raises(ValueError, match="a "):
            kept.publish(bad, scope("a"), "2024-01-05 00:00:00")
    assert kept.read(active_only=True).count() == 2


def _scan(df):
    """Rows that the scan of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan"):
            return p.metrics().apply("numOutputRows").value()
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.children().apply(k) for k in range(p.children().size())]
    raise AssertionError("no scan")


def test_lookups_skip_files(spark):
    rows = spark.range(0, 8000, 2).selectExpr("concat('n', id) as name", "id as value")
    store.rebuild_mapping(rows, "threadloom_names", "name", buckets=8)
    assert spark.table("threadloom_names").count() == 4000
    hit = store.lookup(spark, "threadloom_names", "name", ["n4444"])
    assert [r["value"] for r in hit.collect()] == [4444] and 0 < _scan(hit) < 1000  # rows of one bucket
    none = store.lookup(spark, "threadloom_names", "name", ["n4445"])  # between the least and the largest name
    assert none.count() == 0 and _scan(none) == 0
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    plan = store.lookup(spark, "threadloom_names", "name", ["n4444"])._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    joined = spark.createDataFrame([("n2",), ("n3",)], "name string").hint("shuffle_merge").join(spark.table("threadloom_names"), "name")
    assert [r["value"] for r in joined.collect()] == [2]
    store.rebuild_mapping(rows.limit(10), "threadloom_names", "name", buckets=4)
    assert spark.table("threadloom_names").count() == 10
    spark.sql("drop table threadloom_names")


def test_database_reads_are_partitioned(spark):
    url, properties = "jdbc:derby:memory:threadloom;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(100).selectExpr("cast(id as int) as id", "concat('p', id) as name", "if(id % 10 = 0, '', concat('select ', id)) as code")
    rows.write.format("jdbc").options(url=url, dbtable="programs", createTableColumnTypes="id int, name varchar(20), code varchar(40)", **properties).mode("overwrite").save()
    got = readers.jdbc_sources(spark, url, 'select "id" as id, "name" as name, "code" as code from programs where "code" <> \'\'', properties, key="id", partitions=4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 90
    assert all(n > 10 for n in got.groupBy(F.spark_partition_id()).count().toPandas()["count"])
    few = got.where("id < 7")
    assert few.count() == 6 and "PushedFilters: [*IsNotNull(ID), *LessThan(ID,7)]" in few._jdf.queryExecution().executedPlan().toString()
    sources = readers.program_sources(got, "PROD", "db", "name", "code")
    assert sources.count() == 90 and sources.where("source_hash is null").isEmpty()
    assert readers.jdbc_sources(spark, url, 'select "id" as id from programs where "id" < 0', properties, key="id", partitions=4).count() == 0
    assert readers.jdbc_sources(spark, url, 'select "id" as id from programs', properties).rdd.getNumPartitions() == 1
