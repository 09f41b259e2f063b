"""Line dedup with two Bloom filters.

Each task sets, for the distinct keys of each of its documents, bits in a filter of keys seen once and, where
a bit was set before, in a filter of keys seen twice. Filters of two tasks merge by

    twice = twice_1 | twice_2 | (once_1 & once_2),  once = once_1 | once_2

so a key of two documents is always in the merged second filter. Tasks send set bits only, by segment
of the filter; segments merge in parallel, groups of tasks first. The second filter, of at most `most_bits` bits, goes to all tasks.

Only keys that it holds are suspects: they shuffle as 128-bit digests with their doc_id, digests found in two
documents are confirmed with their least doc_id, and all other documents lose those lines. A fuller filter
means more suspects, never another result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import column, fields, fresh, hot_join, lean, mapped, store, table

SPACES = b" \t\n\r\x0b\x0c"
SEGMENT_BITS = 1 << 20
HASHES = 4
#: Tasks are merged in this many groups, and then the groups: about 1,000 rows at once for a million tasks.
MERGED_AT_ONCE = 1024
NO_ID = -(1 << 63)


def key_of(line: bytes, shortest: int) -> bytes | None:
    key = line.strip(SPACES).lower()
    if len(key) < shortest or (not key.isascii() and len(key.decode(errors="replace")) < shortest):
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _digests(text: bytes | None, shortest: int) -> set[bytes]:
    keys = {key_of(line, shortest) for line in (text or b"").split(b"\n")}
    keys.discard(None)
    return {digest(k) for k in keys}


def positions(digests: bytes, bits: int) -> np.ndarray:
    """keys x HASHES bit positions; bits is a power of two."""
    h = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    k = np.arange(HASHES, dtype=np.uint64)
    return (h[:, :1] + k * (h[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def _bits(positions: np.ndarray) -> bytes:
    """Some positions in a segment, or all its bits if that is shorter."""
    if 4 * len(positions) < SEGMENT_BITS // 8:
        return positions.astype("<u4").tobytes()
    dense = np.zeros(SEGMENT_BITS, bool)
    dense[positions.astype(np.int64)] = True
    return np.packbits(dense, bitorder="little").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT_BITS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    return np.frombuffer(data, "<u4")


def _mark(bits: int, shortest: int, batches):
    """Rows (segment, part, once, twice): set bits of each segment."""
    once, twice, held, n_held = np.empty(0, np.uint64), np.empty(0, np.uint64), [], 0

    def flush():
        nonlocal once, twice, n_held
        hits, n = np.unique(np.concatenate([positions(b"".join(x), bits).ravel() for x in held] or [once[:0]]), return_counts=True)
        again = hits[n > 1]
        twice = np.union1d(twice, np.union1d(again, np.intersect1d(hits, once, assume_unique=True)))
        once = np.union1d(once, hits)
        held.clear()
        n_held = 0

    for batch in batches:
        for x in batch.column(0):
            found = _digests(x.as_py(), shortest)
            held.append(found)
            n_held += len(found)
            if n_held > 500_000:
                flush()
    flush()
    part = TaskContext.get().partitionId() % MERGED_AT_ONCE
    segments = once // np.uint64(SEGMENT_BITS)
    for s in np.unique(segments).tolist():
        a, b = np.uint64(s * SEGMENT_BITS), np.uint64((s + 1) * SEGMENT_BITS)
        both = [_bits(x[np.searchsorted(x, a) : np.searchsorted(x, b)] - a) for x in (once, twice)]
        yield pa.RecordBatch.from_pydict({"segment": [s], "part": [part], "once": [both[0]], "twice": [both[1]]})


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """One segment's filters over some tasks; a row is at most the segment's bits, twice."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for x, y in zip(rows["once"], rows["twice"], strict=True):
        a = _unpacked(x.as_py())
        twice[_unpacked(y.as_py())] = True
        twice[a[once[a]]] = True
        once[a] = True
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "once": [_bits(np.flatnonzero(once))], "twice": [_bits(np.flatnonzero(twice))]})


def _suspects(bits: int, shortest: int, shared, batches):
    twice = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        docs, keys = [], []
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = sorted(_digests(x.as_py(), shortest))
            if found:
                at = positions(b"".join(found), bits)
                seen = (twice[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
                hit = [found[k] for k in np.flatnonzero(seen).tolist()]
                docs += [i] * len(hit)
                keys += hit
        yield pa.RecordBatch.from_pydict({"id": pa.array(docs, pa.int64()), "key": pa.array(keys, pa.binary())})


def _rewrite(shortest: int, n_kept: int, names: list[str], batches):
    """The kept columns, which come first, and the new ones; the last two are the text and the digests that it loses."""
    for batch in batches:
        texts, lines, dropped = [], [], []
        for x, gone in zip(batch.column(n_kept), batch.column(n_kept + 1), strict=True):
            parts = (x.as_py() or b"").split(b"\n")
            lost = set(gone.as_py() or ())
            kept = [p for p in parts if (k := key_of(p, shortest)) is None or digest(k) not in lost] if lost else parts
            texts.append(b"\n".join(kept).decode(errors="replace"))
            lines.append(len(parts))
            dropped.append(len(parts) - len(kept))
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=names)


def dedup_lines(docs: DataFrame, shortest: int = 10, bits_per_line: int = 16, most_bits: int = 1 << 28, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with text rewritten, and n_lines (before) and n_dropped added.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least `shortest` code points that two documents hold stay in the least doc_id's document only.

    Nulls, empties and repeats: a null text counts as one empty line and comes back empty; rows without a
    doc_id count as one document that comes before all others; rows that share a doc_id are one document, so they
    drop the same lines. Columns of docs named n_lines or n_dropped give way.
    """
    spark = docs.sparkSession
    new = ["text", "n_lines", "n_dropped"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    binary = F.col("text").cast("binary")
    n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = SEGMENT_BITS
    while bits < most_bits and bits < n * bits_per_line:
        bits *= 2

    filters = "segment long, once binary, twice binary"
    marks = docs.select(binary).mapInArrow(functools.partial(lean, _mark, bits, shortest), "segment long, part long, once binary, twice binary")
    merged = marks.groupBy("segment", "part").applyInArrow(_merge, filters).groupBy("segment").applyInArrow(_merge, filters)
    twice = np.zeros(bits, bool)
    for row in merged.select("segment", "twice").toLocalIterator():
        twice[row["segment"] * SEGMENT_BITS + _unpacked(bytes(row["twice"])).astype(np.int64)] = True
    shared = spark.sparkContext.broadcast(np.packbits(twice, bitorder="little").tobytes())

    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    suspects = store(docs.select(ident.alias("id"), binary.alias("text")).mapInArrow(functools.partial(lean, _suspects, bits, shortest, shared), "id long, key binary"), "suspects")
    first = suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    first = store(first.select("key", "first", "n"), "firsts")
    gone = hot_join(suspects, first, "key", "n", 64).where("id > first").groupBy("id").agg(F.collect_set("key").alias("gone"))
    a, b, c, d = fresh(docs, "text", "id", "other", "gone")
    gone = store(gone.toDF(c, d), "gone")
    rows = docs.select(*map(column, kept), binary.alias(a), ident.alias(b)).join(gone, F.col(b) == F.col(c), "left").select(*map(column, kept), a, d)
    schema = fields(docs, kept, text="string", n_lines="long", n_dropped="long")
    out = mapped(rows, schema, _rewrite, shortest, len(kept))
    return out.select(*map(column, dict.fromkeys([*(c for c in docs.columns if c in kept or c == "text"), *new])))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line AS line, u.pos AS pos,
         regexp_replace(regexp_replace(u.line, '^[ \t\n\r\x0b\x0c]+', ''), '[ \t\n\r\x0b\x0c]+$', '') AS bare
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u
), keyed AS (
  SELECT *, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, (first_doc IS NOT NULL AND keyed.doc_id <> first_doc) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
