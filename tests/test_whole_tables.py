"""Queries that take every chain, against plain Python over the whole tables."""

from __future__ import annotations

import os

import pytest

from threadloom.plans import catalogue, metadata_queries
from threadloom.plans.relations import relation, run

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _reached(edges, starts):
    """(start, node): least number of edges from start, itself at 0."""
    out, level = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    for s in starts:
        last, depth, seen = {s}, 0, {s}
        while last:
            level |= {(s, n): depth for n in last}
            last, depth = {b for a in last for b in out.get(a, ())} - seen, depth + 1
            seen |= last
    return level


def test_every_chain_has_its_rows(spark):
    rows = lambda name: catalogue.QUERIES[name](spark, SF).collect()
    edges = {(r["src"], r["dst"]) for r in relation(spark, SF, "edges_chain").collect()}
    level = _reached(edges, {a for a, _ in edges})
    want: dict[int, int] = {}
    for s, n in level:
        want[s] = want.get(s, 0) + (n != s)
    assert {r["src"]: r["reached"] for r in rows("reachability_closure")} == want
    first = {a for a, _ in edges} - {b for _, b in edges}
    assert {r["node"]: r["level"] for r in rows("topological_levels")} == {n: d for (s, n), d in level.items() if s in first}
    orders = run(spark, SF, "select o_orderkey, o_custkey, o_orderstatus from orders").collect()
    plans = {f"PLAN{r['o_custkey']}" for r in orders if r["o_orderstatus"] == "F"}
    found = {r["plan"] for r in rows("plan_receipts")}
    assert found <= {f"PLAN{r['o_custkey']}" for r in orders} and {p for p in plans if int(p[4:]) % 20} & found
    deps = {(str(r["o_orderkey"] % 700), str(r["o_custkey"] % 900)) for r in orders}
    assert {(r["job"], r["unload"]) for r in rows("two_hop_chain")} == deps


def test_walks_end_where_the_graph_ends(spark):
    rows = lambda name: catalogue.QUERIES[name](spark, SF).collect()
    edges = {(r["src"], r["dst"]) for r in relation(spark, SF, "edges_cycle").collect()}
    starts = [r["start"] for r in run(spark, SF, "select min(o_orderkey) as start from orders group by o_custkey").collect()]
    want = _reached(edges, starts)
    assert {(r["start"], r["node"]): r["level"] for r in rows("dependents_by_level")} == want and max(want.values()) > 12
    columns = {(f"S.{r['a']}.{r['b']}".upper(), f"S.{r['c']}.{r['d']}".upper()) for r in run(spark, SF, metadata_queries._COLUMNS).collect()}
    want = _reached(columns, ["S.T0.C1"])
    assert {(r["start"], r["node"]): r["level"] for r in rows("column_walk")} == want and max(want.values()) > 6
    reads, writes = ({(r["job"], r["tab"]) for r in run(spark, SF, t).collect()} for t in (metadata_queries._READS, metadata_queries._WRITES))
    up = {(f"table:{t}", f"task:{j}") for j, t in writes} | {(f"task:{j}", f"table:{t}") for j, t in reads - writes}
    want = _reached(up, ["table:T1", "table:T7"])
    assert {(f"table:{r['start']}", f"{r['kind']}:{r['node']}"): r["column"] for r in rows("layered_upstream")} == want and max(want.values()) > 9
