from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph, snapshot


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def _plain_bfs(pairs, root, depth, most):
    out = {}
    for a, b in sorted(set(pairs)):
        out.setdefault(a, []).append(b)
    seen, queue, truncated = {root: 0}, deque([root]), False
    while queue:
        n = queue.popleft()
        for b in out.get(n, []):
            if b not in seen:
                if seen[n] < depth and len(seen) < most:
                    seen[b] = seen[n] + 1
                    queue.append(b)
                else:
                    truncated = True
    return seen, {(a, b) for a, b in set(pairs) if a in seen and b in seen}, truncated


@pytest.mark.parametrize("seed", range(4))
def test_bfs_equals_a_plain_one(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randint(0, 12)}", f"n{rng.randint(0, 12)}") for _ in range(22)]
    depth, most = rng.randint(1, 5), rng.randint(1, 10)
    got = graph.bounded_bfs(_edges(spark, [*pairs, (None, "n1"), ("n1", None)]), "n0", "down", depth, most)
    seen, inside, truncated = _plain_bfs(pairs, "n0", depth, most)
    assert {r["node"]: r["depth"] for r in got.nodes.collect()} == seen
    assert {tuple(r) for r in got.edges.collect()} == inside and got.truncated == truncated


def test_natural_boundary_and_missing_root(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("c", "c")])
    whole = graph.bounded_bfs(e, "a", max_nodes=3)
    assert not whole.truncated and whole.edges.count() == 3
    assert graph.bounded_bfs(e, "a", max_nodes=2).truncated  # the root counts
    assert not graph.bounded_bfs(e, "zz").root_found
    assert {r["node"] for r in graph.bounded_bfs(e, "c", "up").nodes.collect()} == {"a", "b", "c"}


def test_strong_components_and_levels(spark):
    e = _edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("x", "y"), ("y", "z"), ("z", "x")])
    got = {(r["node"], r["component"], r["size"]) for r in graph.strong_components(e).collect()}
    assert got == {("a", "a", 2), ("b", "a", 2), ("x", "x", 3), ("y", "x", 3), ("z", "x", 3)}
    peeled = {r["node"]: r["level"] for r in graph.topological_levels(_edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("q", "q")])).collect()}
    assert peeled == {"a": 0, "b": 1, "c": 2}


def test_collapse_counts_every_path(spark):
    pairs, want = [], 0
    for k in range(10):  # a ladder of ten diamonds: 2 ** 10 paths
        pairs += [(f"t{k}", f"l{k}"), (f"t{k}", f"r{k}"), (f"l{k}", f"t{k + 1}"), (f"r{k}", f"t{k + 1}")]
    pairs = [("A", "t0"), *pairs, ("t10", "B"), ("B", "B"), ("lost", "nowhere")]
    nodes = {n for p in pairs for n in p}
    kinds = spark.createDataFrame([(n, n[0] in "tlr") for n in nodes], "node string, collapsible boolean")
    want = {("A", "B", 1024), ("B", "B", 1), }
    assert {(r["src"], r["dst"], r["paths"]) for r in graph.collapse(_edges(spark, pairs), kinds).collect() if r["src"] in "AB"} == want


def _simple_paths(pairs, inner):
    """Every path between outer nodes through inner ones that meets no node twice (but may end where it began)."""
    out = {}

    def walk(path):
        for a, b in sorted(set(pairs)):
            if a == path[-1] and (b not in path or (b == path[0] and b not in inner)):
                if b in inner:
                    walk([*path, b])
                else:
                    out.setdefault((path[0], b), []).append([*path, b])

    for n in {n for p in pairs for n in p} - inner:
        walk([n])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_collapse_with_cycles_and_samples(spark, seed):
    rng = random.Random(seed)
    inner = {f"t{k}" for k in range(5)}
    names = [*sorted(inner), "A", "B", "C"]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(16)] + [("A", "t0"), ("t0", "t1"), ("t1", "t0"), ("t1", "B")]
    kinds = spark.createDataFrame([(n, n in inner) for n in names], "node string, collapsible boolean")
    want = _simple_paths(pairs, inner)
    got = {(r["src"], r["dst"]): (r["paths"], r["depth"]) for r in graph.collapse(_edges(spark, pairs), kinds).collect()}
    assert got == {k: (len(v), min(map(len, v)) - 1) for k, v in want.items()}
    few = {(r["src"], r["dst"]): (r["paths"], r["depth"]) for r in graph.collapse(_edges(spark, pairs), kinds, most_states=1).collect()}
    assert few == {k: (None, d) for k, (_, d) in got.items()}
    samples = {}
    for r in graph.path_samples(_edges(spark, pairs), kinds, most=1000).collect():
        samples.setdefault((r["src"], r["dst"]), []).append((r["place"], r["path"]))
    assert {k: [p for _, p in sorted(v)] for k, v in samples.items()} == {k: sorted(v, key=lambda p: (len(p), p)) for k, v in want.items()}


def test_boundary_keeps_loops_apart(spark):
    e = spark.createDataFrame([("p", "s", "m"), ("p", "m", "t"), ("p", "u", "v"), ("p", "v", "u"), ("p", "t", "t"), ("q", "t", "w")], "program string, src string, dst string")
    got = graph.program_boundary(e, spark.createDataFrame([("p", "t"), ("q", "w")], "program string, target string"))
    assert {tuple(r) for r in got.collect()} == {("p", "t", "s"), ("p", "t", "t"), ("q", "w", "t")}


def test_chunks_hold_their_closures(spark):
    pairs = [(f"g{g}n{k}", f"g{g}n{k + 1}") for g in range(30) for k in range(6)]
    rows = graph.pack_closures(_edges(spark, pairs), most=20).collect()
    chunk = {r["node"]: r["chunk"] for r in rows}
    assert len(rows) == 210 and all(chunk[a] == chunk[b] for a, b in pairs)
    sizes = {}
    for c in chunk.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) <= 20
    with pytest.raises(ValueError):
        graph.pack_closures(_edges(spark, pairs), most=5)


def test_chunks_of_a_large_group_repeat_what_they_share(spark):
    """Many tops over one shared base, a cycle, and a pair: no weak group fits, each closure does."""
    pairs = [(f"top{k}", "mid") for k in range(40)] + [("mid", f"low{k}") for k in range(5)] + [("c1", "c2"), ("c2", "c1"), ("c2", "mid"), ("x", "y")]
    closure = {}
    for n in {n for p in pairs for n in p}:
        seen, todo = set(), [n]
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += [b for a, b in pairs if a == m]
        closure[n] = seen
    chunks = {}
    for r in graph.pack_closures(_edges(spark, pairs), most=12).collect():
        assert r["node"] not in chunks.setdefault(r["chunk"], set())
        chunks[r["chunk"]].add(r["node"])
    assert all(len(c) <= 12 and all(closure[n] <= c for n in c) for c in chunks.values())
    assert set().union(*chunks.values()) == set(closure)


@pytest.mark.parametrize("seed", range(1, 2))
def test_strong_components_equal_mutual_reach(spark, seed):
    rng = random.Random(seed)
    n = rng.randint(8, 30)
    pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(int(n * rng.choice([1.0, 1.3, 2.0])))] + [(f"r{k}", f"r{(k + 1) % 40}") for k in range(40)]
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            for x, y in pairs:
                if x == todo[-1] and y not in seen:
                    seen.add(y)
                    todo.insert(0, y)
            todo.pop()
        reach[a] = seen
    want = {}
    for a in reach:
        group = {b for b in reach if b in reach[a] and a in reach[b]} | {a}
        if len(group) > 1:
            want[a] = (min(group), len(group))
    assert {r["node"]: (r["component"], r["size"]) for r in graph.strong_components(_edges(spark, pairs)).collect()} == want


def test_dependents_of_several_starts(spark):
    e = _edges(spark, [("a", "b"), ("b", "c"), ("d", "c"), ("c", "a")])
    found, lost = graph.dependents_of(e, spark.createDataFrame([("d", 0), ("a", 1), ("q", 2)], "start string, place int"))
    assert {tuple(r) for r in found.collect()} == {("d", "d", 0), ("a", "a", 0), ("c", "d", 1), ("b", "d", 3)} and [r[0] for r in lost.collect()] == ["q"]


def test_upstream_stops_at_the_layer(spark):
    e = _edges(spark, [("DWF.a", "DWM.b"), ("ODS.x", "DWF.a"), ("DWM.b", "DWA.c"), ("src", "DWA.c"), ("DWA.c", "DWM.b")])
    stop = F.startswith("node", F.lit("DWF."))
    got = {tuple(r) for r in graph.trace_upstream(e, spark.createDataFrame([("DWA.c",), ("DWF.a",)], "start string"), stop).collect()}
    assert got == {("DWA.c", "DWA.c", 0, None), ("DWA.c", "DWM.b", 1, None), ("DWA.c", "src", 1, "NATURAL"), ("DWA.c", "DWF.a", 2, "STOP"), ("DWF.a", "DWF.a", 0, None), ("DWF.a", "ODS.x", 1, "NATURAL")}


def test_included_nodes_and_program_edges(spark):
    edges = spark.createDataFrame([("p", "S.a", "tmp"), ("p", "tmp", "S.b"), ("p", "S.x", "S.y"), ("q", "S.a", "S.b"), ("q", "S.c", "S.d")], "program string, src string, dst string")
    choices = spark.createDataFrame([("p", "S.b", "AUTHORITATIVE"), ("q", None, "NONE")], "program string, target string, choice string")
    assert {tuple(r) for r in graph.included(edges, choices).collect()} == {("p", "S.a"), ("p", "tmp"), ("p", "S.b"), ("q", "S.a"), ("q", "S.b"), ("q", "S.c"), ("q", "S.d")}
    kinds = spark.createDataFrame([("p", "tmp", True)], "program string, node string, collapsible boolean")
    got = {tuple(r) for r in graph.program_edges(edges, kinds, choices).collect()}
    assert got == {("p", "S.a", "S.b", 1, 2), ("q", "S.a", "S.b", 1, 1), ("q", "S.c", "S.d", 1, 1)}


def test_boundary_groups_and_fallback(spark):
    programs = spark.createDataFrame([("p1", "n1", 1, "T.a"), ("p2", "n2", 2, "T.a"), ("p3", "n3", 1, "T.b"), ("p4", "n4", None, "T.c")], "program string, name string, step int, target string")
    edges = spark.createDataFrame(
        [("p1", "n1", "S.x", "tmp"), ("p2", "n2", "tmp", "T.a"), ("p2", "n2", "T.a", "T.a"), ("o", "o", "S.z", "T.a"), ("p3", "n3", "S.x", "T.q"), ("o", "o", "S.w", "T.b"), ("p4", "bad", "S.v", "T.c"), ("p4", "n4", "T.c", "T.d")],
        "program string, name string, src string, dst string",
    )
    bad = {(r["target"], r["diagnostic"].removeprefix("PROGRAM_BOUNDARY_")) for r in graph.boundary_diagnostics(programs, edges).collect()}
    assert bad == {("T.b", "RESULT_NOT_OBSERVED"), ("T.c", "DUPLICATE_STEP"), ("T.c", "EDGE_PROVENANCE_MISMATCH"), ("T.c", "RESULT_USED_AS_SOURCE")}
    got = {tuple(r) for r in graph.boundary_projections(programs, edges).collect()}
    assert got == {("T.a", "S.x", "p1", False), ("T.a", "T.a", "p2", False), ("T.a", "S.z", "o", False), ("T.b", "S.w", "o", True), ("T.c", "S.v", "p4", True)}


def _simple_paths(edges, inner, most):
    """Of each pair of outer nodes the first paths through inner ones, none twice on a path."""
    out = {}

    def walk(path):
        for b in sorted({y for x, y in edges if x == path[-1]}):
            if b not in inner:
                if b not in path[1:]:
                    out.setdefault((path[0], b), []).append((*path, b))
            elif b not in path:
                walk((*path, b))

    for a in sorted({x for x, _ in edges} - inner):
        walk((a,))
    return {k: sorted(v, key=lambda p: (len(p), p))[:most] for k, v in out.items()}


def test_first_paths_of_graphs_with_cycles(spark):
    rng = random.Random(12)
    edges, inner = set(), {f"i{k}" for k in range(6)}
    nodes = sorted(inner) + ["a", "b", "z"]
    while len(edges) < 26:
        edges.add((rng.choice(nodes), rng.choice(nodes)))
    edges = {e for e in edges if e[0] != e[1]}
    kinds = spark.createDataFrame([(n, n in inner) for n in nodes], "node string, collapsible boolean")
    for most in (1, 4):
        got = {}
        for r in graph.path_samples(spark.createDataFrame(sorted(edges), "src string, dst string"), kinds, most).orderBy("place").collect():
            got.setdefault((r["src"], r["dst"]), []).append(tuple(r["path"]))
        assert got == _simple_paths(edges, inner, most) and got


def test_migrations_are_refused(spark):
    scope = [c for c in snapshot.SCOPE]
    rows = spark.createDataFrame([("a",) * len(scope) + ("1",), ("b",) * len(scope) + ("2",)], ", ".join(f"{c} string" for c in [*scope, "version"]))
    scopes = lambda *names: spark.createDataFrame([(n,) * len(scope) for n in names], ", ".join(f"{c} string" for c in scope))
    snapshot.migration_gate(rows, "2", scopes("a"), complete=True)
    snapshot.migration_gate(rows.where("version = '2'"), "2", scopes(), complete=False)
    for kwargs in ({"scopes": scopes("a"), "complete": False}, {"scopes": scopes("a"), "complete": True, "partial": True}, {"scopes": scopes("b"), "complete": True}):
        with pytest.raises(ValueError, match="another version"):
            snapshot.migration_gate(rows, "2", **kwargs)
