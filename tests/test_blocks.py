"""Graphs solved in blocks of whole groups, against plain Python and against the set-at-a-time operators."""

from __future__ import annotations

import os
import random

import pytest

from threadloom.operators import blocks, columns, cycles, graph
from threadloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def _reach(pairs):
    after = {n: {b for a, b in pairs if a == n} for p in pairs for n in p}
    out = {}
    for a in after:
        out[a], todo = set(), [a]
        while todo:
            new = after[todo.pop()] - out[a]
            out[a] |= new
            todo += new
    return out


def _components(pairs):
    reach = _reach(pairs)
    parts = {a: {b for b in reach[a] if a in reach[b]} | {a} for a in reach}
    return {a: (min(p), len(p)) for a, p in parts.items() if len(p) > 1}


def _hinted(seed):
    """(src, dst, owner): graphs of owners, some of which meet; an owner may be null."""
    rng = random.Random(seed)
    rows = [(f"n{20 * k + rng.randrange(12)}", f"n{20 * k + rng.randrange(12)}", k) for k in range(12) for _ in range(rng.choice((8, 14, 24)))]
    return rows + [(f"n{rng.randrange(100)}", f"n{rng.randrange(100)}", rng.choice((None, 3))) for _ in range(6)]


@pytest.mark.parametrize("largest", [100_000, 16])
def test_strong_components_by_a_hint(spark, monkeypatch, largest):
    monkeypatch.setattr(blocks, "LARGEST", largest)
    rows = _hinted(1)
    df = spark.createDataFrame(rows, "src string, dst string, owner int")
    want = _components([r[:2] for r in rows])
    assert want and {r["node"]: (r["component"], r["size"]) for r in graph.strong_components(df, "owner").collect()} == want


@pytest.mark.parametrize("largest", [100_000, 16])
def test_strong_components_of_one_graph_a_program(spark, monkeypatch, largest):
    monkeypatch.setattr(blocks, "LARGEST", largest)
    rows = [(f"n{int(a[1:]) % 20}", f"n{int(b[1:]) % 20}", k) for a, b, k in _hinted(1)]
    want = {(k, n): x for k in {r[2] for r in rows} for n, x in _components([r[:2] for r in rows if r[2] == k]).items()}
    found = graph.strong_components_by(spark.createDataFrame(rows, "src string, dst string, program int"), "program").collect()
    assert want and {(r["program"], r["node"]): (r["component"], r["size"]) for r in found} == want


def test_blocks_hold_whole_groups(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(blocks, "BLOCK", 10)
    groups = sorted(random.Random(2).choices(["a", "b", "c", None, "d"], k=60) + ["e"] * 30, key=str)
    batch = pa.RecordBatch.from_pydict({"group": groups})
    found = [t.column(0).to_pylist() for t in blocks.whole(batch.slice(k, 7) for k in range(0, 90, 7))]
    assert sum(found, []) == groups and len(found) > 2 and sum(len(set(x)) for x in found) == len(set(groups))


def _cycles(pairs):
    after, out = {}, set()
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    todo = [(a,) for a in after]
    while todo:
        path = todo.pop()
        for b in after.get(path[-1], ()):
            if b == path[0]:
                out.add(path)
            elif b > path[0] and b not in path:
                todo.append((*path, b))
    return sorted(out, key=lambda c: (len(c), c))


@pytest.mark.parametrize("largest", [100_000, 14])
@pytest.mark.parametrize("marks", [None, ["n3", "n45", "n46"]])
def test_cycle_lists_by_a_hint(spark, monkeypatch, largest, marks):
    monkeypatch.setattr(blocks, "LARGEST", largest)
    rows = [r for r in _hinted(5) if r[2] is None or r[2] < 4]
    pairs = {r[:2] for r in rows}
    parts = {n: c for n, (c, _) in _components(pairs).items()}
    want = {}
    for c in _cycles(pairs):
        if marks is None or set(c) & set(marks):
            want.setdefault(parts.get(c[0], c[0]), []).append(c)
    only = None if marks is None else spark.createDataFrame([(m,) for m in marks], "node string")
    found = cycles.cycle_lists(spark.createDataFrame(rows, "src string, dst string, owner int"), 5, only, "owner").collect()
    got = sorted((r["component"], r["place"], tuple(r["cycle"]), r["more"]) for r in found)
    assert want and got == sorted((p, k + 1, c, len(x) > 5) for p, x in want.items() for k, c in enumerate(x[:5]))


def test_first_cycles_of_long_rings():
    """A long ring with a short way and a shorter ring: three cycles, not a walk for each length."""
    n = 5000
    out = {k: [(k + 1) % n] for k in range(n)}
    out[10], out[30] = [11, 4000], [7, 31]
    found = blocks.first_cycles(out, None, 21)
    assert [(len(c), c[0]) for c in found] == [(24, 7), (1011, 0), (5000, 0)]
    assert [len(c) for c in blocks.first_cycles(out, [4500], 21)] == [1011, 5000]


@pytest.mark.parametrize("most", [1000, 12])
def test_producer_chains_by_a_hint(spark, monkeypatch, most):
    monkeypatch.setattr(columns, "MOST_ROWS", most)
    rng = random.Random(4)
    name = lambda k: f"T{10 * k + rng.randrange(8)}"
    rows = []
    for k in range(12):
        for _ in range(rng.choice((5, 10, 16))):
            source = rng.choice((name(k), name(k), f"X{rng.randrange(3)}", None, f"T{990 + k}" if k % 4 == 0 else f"X{k}"))
            rows.append((rng.choice("GH"), name(k), rng.choice("KV"), source, rng.choice(("K", "V", "V")), rng.choice(("RESOLVED",) * 9 + (rng.choice(("AMBIGUOUS", "UNRESOLVED", "odd", None)),)), k))
    rows += [("G", "T11", "K", "T21", "V", "RESOLVED", 1), ("G", "T31", "V", "T41", "K", "RESOLVED", None), (None, "T5", "V", "X1", "K", "RESOLVED", 0), ("G", None, "K", "X1", "K", "RESOLVED", 0)]
    df = spark.createDataFrame(rows + rows[:9], "program string, table string, column string, source_table string, source_column string, state string, owner int")
    got = lambda df: sorted(map(str, df.collect()))
    want = got(columns.producer_chains(df.drop("owner"), lambda t: t.startswith("T")))
    assert {s for s in ("RESOLVED", "CYCLE", "AMBIGUOUS", "UNRESOLVED", "MISSING") if any(f"'{s}'" in x for x in want)} >= {"RESOLVED", "CYCLE", "UNRESOLVED", "MISSING"}
    assert got(columns.producer_chains(df, lambda t: t.startswith("T"), "owner")) == want


def _tables(spark):
    folder = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/threadloom/{spark.sparkContext.applicationId}"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["scc_members", "cycle_orders", "issue_keys", "dependency_cycles", "cycle_issues", "cycle_lists", "cycle_lists_dense", "producer_chains"])
def test_few_tables_stay(spark, name):
    """Tables of rounds once filled the disk."""
    before = _tables(spark)
    catalogue.QUERIES[name](spark, SF).collect()
    assert len(_tables(spark) - before) <= 6


def test_tables_of_rounds_go(spark):
    before = _tables(spark)
    graph.strong_components(spark.createDataFrame([(f"r{k}", f"r{(k + 1) % 40}") for k in range(40)], "src string, dst string")).collect()
    assert len(_tables(spark) - before) <= 4
