"""Many small graphs at once: the edges of a group lie in one task, which solves a block of whole groups at a time.

Groups are any sets of edges that share no node with others; groups of more than LARGEST edges aren't gathered, but left to the
set-at-a-time operators.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.tables import bounded, store

#: Most edges of a group that one task gathers; edges of a block, from which on it is solved.
LARGEST, BLOCK = 100_000, 50_000


def apart(e: DataFrame, largest: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Of (group, src, dst, ...) the edges of groups that share no node with others and are small, and the rest; None if there is none."""
    ends = e.select("group", F.explode(F.array("src", "dst")).alias("node")).where("node is not null")
    shared = ends.groupBy("node").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a <> b").select("node")
    shared = store(shared, "shared")
    open_ = e.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (largest or LARGEST)).select("group")
    if not shared.isEmpty():
        for c in ("src", "dst"):
            open_ = open_.unionByName(e.join(shared.withColumnRenamed("node", c), c, "left_semi").select("group"))
    return _without(e, store(open_.distinct(), "open"))


def small(e: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of (group, src, dst, ...), groups that share no nodes, the edges of small groups, and the rest; None if there is none."""
    return _without(e, store(e.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST).select("group"), "large"))


def _without(e: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    if open_.isEmpty():
        return e, None
    other = bounded(open_.withColumnRenamed("group", "other"))
    same = F.col("group").eqNullSafe(F.col("other"))
    return e.join(other, same, "left_anti"), e.join(other, same, "left_semi")


def solved(e: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """Rows that solve(group codes, src codes, dst codes, further columns, groups, nodes) gives for blocks of groups of (group, src, dst, ...)."""
    return e.repartition("group").sortWithinPartitions("group").mapInArrow(functools.partial(_each, solve), schema)


def whole(batches):
    """Tables of whole groups from batches sorted by their first column."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
        other = np.flatnonzero(codes != codes[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if rows >= BLOCK and (cut or held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py()):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The sorted distinct values of some columns of one type, and each column as places among them."""
    found = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks()
    found = (found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[found.indices.to_numpy()]
    return found.dictionary.take(pa.array(order)), np.split(codes, np.cumsum([len(x) for x in columns])[:-1])


def _each(solve: Callable, batches):
    for block in whole(batches):
        groups, (group,) = coded(block.column(0))
        names, (src, dst) = coded(block.column(1), block.column(2))
        # a node is a name within its group; numbers go up with the name
        nodes, ends = np.unique(np.concatenate([group, group]) * len(names) + np.concatenate([src, dst]), return_inverse=True)
        yield from solve(*np.split(ends, 2), block, groups.take(pa.array(nodes // len(names))), names.take(pa.array(nodes % len(names)))).to_batches()


def tarjan(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A number for each node's strong component (Tarjan)."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    at, seen, low, part = first[:], [0] * n, [0] * n, [-1] * n
    count = parts = 0
    stack: list[int] = []
    for root in range(n):
        if seen[root]:
            continue
        calls = [root]
        count += 1
        seen[root] = low[root] = count
        stack.append(root)
        while calls:
            v = calls[-1]
            k = at[v]
            if k < first[v + 1]:
                at[v] = k + 1
                w = to[k]
                if not seen[w]:
                    count += 1
                    seen[w] = low[w] = count
                    stack.append(w)
                    calls.append(w)
                elif part[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            calls.pop()
            if calls and low[v] < low[calls[-1]]:
                low[calls[-1]] = low[v]
            if low[v] == seen[v]:
                while part[v] < 0:
                    part[stack.pop()] = parts
                parts += 1
    return np.array(part, np.int64)


def components(src: np.ndarray, dst: np.ndarray, block: pa.Table, groups: pa.Array, names: pa.Array) -> pa.Table:
    """(group, node, component, size) of the strong components of more than one node."""
    part = tarjan(len(names), src, dst)
    _, least, same, size = np.unique(part, return_index=True, return_inverse=True, return_counts=True)
    inner = np.flatnonzero(size[same] > 1)
    return pa.table({"group": groups.take(pa.array(inner)), "node": names.take(pa.array(inner)), "component": names.take(pa.array(least[same[inner]])), "size": pa.array(size[same[inner]], pa.int64())})


def cycles(most: int, src: np.ndarray, dst: np.ndarray, block: pa.Table, groups: pa.Array, names: pa.Array) -> pa.Table:
    """(component, place, cycle, more) of each strong component: its first cycles; a fourth column of the block marks nodes as src."""
    part = tarjan(len(names), src, dst)
    inner = part[src] == part[dst]
    marked = np.zeros(len(names), bool)
    if block.num_columns > 3:
        marked[src[block.column(3).to_numpy()]] = True
    out: dict[int, list[int]] = {}
    graphs: dict[int, dict[int, list[int]]] = {}
    for code in np.unique(src[inner] * len(names) + dst[inner]).tolist():
        u, v = divmod(code, len(names))
        if u not in out:
            out[u] = graphs.setdefault(int(part[u]), {}).setdefault(u, [])
        out[u].append(v)
    places, more, ends, flat = [], [], [0], []
    for graph in graphs.values():
        found = first_cycles(graph, [v for v in graph if marked[v]] if block.num_columns > 3 else None, most + 1)
        for k, cycle in enumerate(found[:most]):
            places.append((min(graph), k + 1))
            more.append(len(found) > most)
            flat += cycle
            ends.append(len(flat))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(flat, pa.int64())))
    return pa.table({"component": names.take(pa.array([c for c, _ in places], pa.int64())), "place": pa.array([k for _, k in places], pa.int32()), "cycle": lists, "more": pa.array(more, pa.bool_())})


def first_cycles(out: dict[int, list[int]], marked: list[int] | None, n: int) -> list[list[int]]:
    """The first n elementary cycles of a graph (node: sorted successors), by length and nodes, each from its least node on; with
    `marked` (sorted) only those through such a node.

    Cycles are found from one node each, from the least (or first marked) on, which then leaves the graph with all that no cycle can pass any
    more. Lengths go up, and a walk goes on only while a way back short enough is left, so few walks don't close.
    """
    into: dict[int, list[int]] = {v: [] for v in out}
    for v, after in out.items():
        for w in after:
            into[w].append(v)
    gone: dict[int, int] = {}
    ways, back = {v: len(x) for v, x in out.items()}, {v: len(x) for v, x in into.items()}
    starts = []
    for turn, s in enumerate(out if marked is None else marked):
        if s in gone:
            continue
        starts.append((turn, s))
        gone[s] = turn
        todo = [s]
        while todo:
            v = todo.pop()
            for near, count in ((out[v], back), (into[v], ways)):
                for w in near:
                    count[w] -= 1
                    if not count[w] and w not in gone:
                        gone[w] = turn
                        todo.append(w)
    never = len(out)
    walks = [_Walks(s, out, into, lambda v, turn=turn: gone.get(v, never) >= turn) for turn, s in starts]
    found: list[list[int]] = []
    while len(found) < n and (walks := [w for w in walks if w.length]):
        length, more = min(w.length for w in walks), []
        for w in walks:
            if w.length == length:
                more += w.closed(n - len(found) - len(more) if marked is None else None)
                if marked is None and len(found) + len(more) >= n:
                    break
        found += more if marked is None else heapq.nsmallest(n - len(found), (c[k:] + c[:k] for c in more for k in [c.index(min(c))]))
    return found


class _Walks:
    """The cycles through a node `s` of those that are still there, length by length; `length` is the next that there may be, or None."""

    def __init__(self, s: int, out: dict[int, list[int]], into: dict[int, list[int]], there: Callable[[int], bool]):
        self.s, self.out, self.into, self.there, self.length = s, out, into, there, 1
        self.far, self.edge, self.depth = {s: 0}, [s], 0

    def _look_back(self) -> None:
        """Distances to s, as far as this length needs them; for long ones of all nodes."""
        while self.edge and (self.depth < self.length - 1 or self.length > 4):
            self.depth += 1
            new = []
            for v in self.edge:
                for w in self.into[v]:
                    if w not in self.far and self.there(w):
                        self.far[w] = self.depth
                        new.append(w)
            self.edge = new

    def closed(self, most: int | None) -> list[list[int]]:
        """The first `most` cycles of this length."""
        self._look_back()
        length, later, found = self.length, None, []
        path, inside, open_ = [self.s], {self.s}, [iter(self.out[self.s])]
        while open_:
            for v in open_[-1]:
                if v == self.s:
                    if len(path) == length:
                        found.append(path[:])
                    far = None
                elif v in inside or not self.there(v):
                    continue
                else:
                    far = self.far.get(v)
                    if far is None and self.edge:
                        far = self.depth + 1
                if far is None:
                    continue
                if len(path) + far > length:
                    later = min(later or len(path) + far, len(path) + far)
                    continue
                path.append(v)
                inside.add(v)
                open_.append(iter(self.out[v]))
                break
            else:
                open_.pop()
                inside.discard(path.pop())
            if most is not None and len(found) >= most:
                return found
        self.length = later
        return found
