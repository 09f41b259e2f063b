"""Document fingerprints: digests of improbable features.

Every window of 32 bytes of the UTF-8 text has an entropy; how many windows of the whole corpus have it says how rare
it is. Of 32 neighbouring windows the rarest one (the first of equals) is named once; a window that at least 8 neighbourhoods
name is a feature. Windows of next to no entropy (runs of one character) never are. Short texts have few such windows, so those
below `SHORT` bytes add windows of 8 bytes chosen by their hash: all up to 64 bytes, and of n bytes one in (n / 64)^2. A text
without a feature has one: itself. Features are hashed, each sets 5 bits of a Bloom filter of 2,048 bits, and after 160 new features the
next filter of the chain begins.

Likeness holds each filter against its best partner in the other chain: common bits beyond those that chance gives, divided by the
bits of the fuller filter beyond chance, and nothing below `CUT`; weighted by bits, the mean of both directions.
Equal fingerprints have 1, and an empty text's has 0 with all others.

A feature depends on the 64 bytes around it only, so long texts are read in segments, short ones many at a time, with
the same result. The rarities are one sum over all windows of all documents, a thousand numbers.

Next documents: rows are ordered by doc_id (null first), then by the text's hash and their place in the table. They cross one shuffle, to intervals
of about equal bytes; the first row of each interval goes to the one before as well. The table must give the same rows
in the same order when it is read again, as files do; an interval without its neighbour raises.

Nulls, empties and repeats: a null text is empty; an empty text has the fingerprint '0:'; rows that share a doc_id are
documents of their own, neighbours in the order above; the only row of a table is its own next document. An empty table gives no row. Further
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import lean, store, table
from threadloom.llm.shingles import mix

WINDOW, NAMED, BINS = 32, 8, 1000
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 160, 5
#: Normalised entropy (in thousandths) below which a window is no feature, and likeness of filters below which they have nothing in common.
LEAST, CUT = 200, 0.1
SHORT = 1024
_PLACE = 21  # bits of a place in a buffer
_BUFFER, _SEGMENT = 1 << 17, 1 << 19
_NONE = np.int32(0x7FFFFFFF)
_k = np.arange(WINDOW + 1)
_SUM = np.round(1024 * _k * np.log2(np.maximum(_k, 1))).astype(np.int32)
_STEP = np.diff(_SUM, prepend=0).astype(np.int32)
_TOP = int(_SUM[WINDOW])
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy, 0 to BINS, of the window at each place; all in integers, so equal windows are equal anywhere.

    From a window to the next, one byte leaves and one enters. What that changes depends on how often each is in its own window,
    which comparisons with the neighbours at 1 to 31 bytes count for all places at once.
    """
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int32)
    before, after, same = np.ones(n, np.uint8), np.ones(n, np.uint8), np.empty(n, bool)
    for d in range(1, WINDOW):
        x = np.equal(data[d:], data[:-d], out=same[: n - d])
        before[d:] += x
        after[:-d] += x
    sums = np.empty(n - WINDOW + 1, np.int32)
    sums[0] = _SUM[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(_STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]], out=sums[1:])
    sums[1:] += sums[0]
    return (_TOP - sums) * np.int32(BINS) // np.int32(_TOP)


def _buffers(texts: list[bytes]):
    """(bytes, [(number of the text, first, end)], first place that counts, end of those) in pieces of bounded size."""
    held, n = [], 0

    def packed():
        at, spans = 0, []
        for k in held:
            spans.append((k, at, at + len(texts[k])))
            at += len(texts[k])
        return np.frombuffer(b"".join(texts[k] for k in held), np.uint8), spans, 0, at

    for k, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        if len(text) > _SEGMENT:
            data = np.frombuffer(text, np.uint8)
            for at in range(0, len(data), _SEGMENT):
                low, high = max(0, at - WINDOW), min(len(data), at + _SEGMENT + 2 * WINDOW)
                yield data[low:high], [(k, 0, high - low)], at - low, min(len(data), at + _SEGMENT) - low
            continue
        if held and n + len(text) > _BUFFER:
            yield packed()
            held, n = [], 0
        held.append(k)
        n += len(text)
    if held:
        yield packed()


def _across(keys: np.ndarray, spans, value) -> None:
    """Windows that begin in a text and end in the next one."""
    for _, first, end in spans:
        keys[max(first, end - WINDOW + 1) : end] = value


def _small(text: bytes) -> np.ndarray:
    """Hashes of the windows of 8 bytes that a short text adds."""
    if not 8 <= len(text) < SHORT:
        return np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    h = mix(np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(np.uint64).ravel() + np.uint64(0x9E3779B97F4A7C15))
    most = ((1 << 64) - 1) * 64**2 // max(64, len(text)) ** 2
    return h[h <= np.uint64(most)]


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The hashes of each text's distinct features, in order of first appearance."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for data, spans, low, high in _buffers(texts):
        bins = entropies(data)
        keys = (ranks[bins] << np.int32(_PLACE)) | np.arange(len(bins), dtype=np.int32)
        keys[bins < LEAST] = _NONE
        _across(keys, spans, _NONE)
        edge = np.full(WINDOW - 1, _NONE)
        least, width = np.concatenate([edge, keys, edge]), 1
        while width < WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        named = np.bincount(least[least != _NONE] & np.int32((1 << _PLACE) - 1), minlength=len(keys))
        at = np.flatnonzero(named >= NAMED)
        at = at[(at >= low) & (at < high)]
        words = data[at[:, None] + np.arange(WINDOW)].view(np.uint64)
        hashes = np.zeros(len(at), np.uint64)
        for j in range(WINDOW // 8):
            hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[:, j])
        places = np.searchsorted(at, [x for _, first, end in spans for x in (first, end)])
        for (k, _, _), a, b in zip(spans, places[::2].tolist(), places[1::2].tolist(), strict=True):
            found[k].append(hashes[a:b])
    out = []
    for text, parts in zip(texts, found, strict=True):
        h = parts[0] if len(parts) == 1 and len(text) >= SHORT else np.concatenate([*parts, _small(text)])
        if not len(h) and text:
            h = np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), np.uint64)
        _, first = np.unique(h, return_index=True)
        out.append(h[np.sort(first)])
    return out


def digest(hashes: np.ndarray) -> str:
    """'<features>:<filters in base64>'."""
    chain = -(-len(hashes) // FILTER_FEATURES)
    bits = np.zeros(chain * FILTER_BITS, bool)
    start = (np.arange(len(hashes)) // FILTER_FEATURES * FILTER_BITS).astype(np.uint64)
    for k in range(FEATURE_BITS):
        bits[start + (hashes >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)] = True
    return f"{len(hashes)}:{base64.b64encode(np.packbits(bits).tobytes()).decode()}"


def likeness(a: str, b: str) -> float:
    """0 to 1, symmetric."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(d.partition(":")[2]), np.uint64).reshape(-1, FILTER_BITS // 64) for d in (a, b))
    if not len(x) or not len(y):
        return 0.0
    n, m = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x, y))
    best_x, best_y = np.zeros(len(x)), np.zeros(len(y))
    step = max(1, (1 << 18) // y.size)
    for k in range(0, len(x), step):
        common = np.bitwise_count(x[k : k + step, None] & y).sum(axis=2, dtype=np.int64)
        chance = n[k : k + step, None] * m / FILTER_BITS
        near = (common - chance) / (np.maximum(n[k : k + step, None], m) - chance)
        near[near < CUT] = 0
        best_x[k : k + step] = near.max(axis=1)
        np.maximum(best_y, near.max(axis=0), out=best_y)
    return float(min(1.0, (n @ best_x / n.sum() + m @ best_y / m.sum()) / 2))


def _histogram(batches):
    total = np.zeros(BINS + 1, np.int64)
    for batch in batches:
        for data, spans, low, high in _buffers([t.as_py() or b"" for t in batch.column(0)]):
            bins = entropies(data)
            _across(bins, spans, -1)
            bins = bins[low:high]
            total += np.bincount(bins[bins >= 0], minlength=BINS + 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bin": at, "n": total[at]})


def rarities(docs: DataFrame) -> np.ndarray:
    """The place of each entropy, the rarest first, over all windows of all texts; at most BINS + 1 sums reach the driver."""
    counts = np.zeros(BINS + 1, np.int64)
    sums = docs.select(F.col("text").cast("binary")).mapInArrow(functools.partial(lean, _histogram), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        counts[row["bin"]] = row["n"]
    ranks = np.empty(BINS + 1, np.int32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BINS + 1, dtype=np.int32)
    return ranks


def _sort_keys(ids, hashes, places) -> np.ndarray:
    """(doc_id with nulls first, hash, place) as byte strings in that order."""
    flip = lambda x: (np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    known = ~pd.isna(ids)
    parts = [known.astype(np.uint8).reshape(-1, 1), flip(np.where(known, ids, 0).astype(np.int64)), flip(hashes), flip(places)]
    return np.ascontiguousarray(np.hstack(parts)).view("S25").ravel()


def _cuts(room: int, batches):
    """The first row of each `room` bytes of a sorted part."""
    n = room
    for batch in batches:
        first = []
        for k, size in enumerate(batch.column("n_bytes").to_pylist()):
            if n >= room:
                first.append(k)
                n = 0
            n += size + 64
        yield batch.take(pa.array(first, pa.int64()))


def _neighbours(docs: DataFrame, shard_bytes: int, most_shards: int) -> DataFrame | None:
    """Rows (part, guest, id, text), sorted in their parts: a guest is the first row of the next part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    slim = store(rows.select("id", "hash", "place", F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    total, n = slim.agg(F.sum(F.col("n_bytes") + 64), F.count(F.lit(1))).first()
    if not n:
        return None
    order = [F.col("id").asc_nulls_first(), "hash", "place"]
    room = max(shard_bytes, total // most_shards)
    ranged = slim.repartitionByRange(max(1, -(-n // 2_000_000)), *order).sortWithinPartitions(*order)
    found = ranged.mapInArrow(functools.partial(_cuts, room), slim.schema).toPandas()
    starts = np.sort(_sort_keys(found["id"].to_numpy(), found["hash"], found["place"]))
    parts = len(starts)

    @F.pandas_udf("long")
    def part_of(ids: pd.Series, hashes: pd.Series, places: pd.Series) -> pd.Series:
        keys = _sort_keys(ids.to_numpy(), hashes, places)
        at = np.searchsorted(starts, keys, side="right") - 1
        return pd.Series(2 * at + (starts[np.maximum(at, 0)] == keys))

    code = part_of(F.col("id"), F.col("hash"), F.col("place"))
    own = F.floor(F.col("code") / 2).cast("int")
    to = F.when(F.col("code") % 2 == 1, F.array(F.struct(own.alias("part"), F.lit(0).alias("guest")), F.struct(F.pmod(own - 1, F.lit(parts)).alias("part"), F.lit(1).alias("guest"))))
    dealt = rows.withColumn("code", code).select("id", "hash", "place", "text", F.explode(F.coalesce(to, F.array(F.struct(own.alias("part"), F.lit(0).alias("guest"))))).alias("to"))
    dealt = dealt.select("to.part", "to.guest", "id", "hash", "place", "text").repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("part", "guest", *order).select("part", "guest", "id", "text")


def _compare(ranks: np.ndarray, batches):
    """Rows of _RESULT: each document with the one behind it."""
    names = [f.split()[0] for f in _RESULT.split(", ")]
    last = None  # (part, guest, id, text, fingerprint) of the document that waits for its next one

    def compared(part):
        nonlocal last
        prints = [digest(h) for h in features([r[3] for r in part], ranks)]
        rows = [] if last is None else [last]
        rows += [(*r, p) for r, p in zip(part, prints, strict=True)]
        pairs, edited, sizes = [], [], []
        for a, b in zip(rows, rows[1:], strict=False):
            if a[0] != b[0]:
                if not a[1]:
                    raise ValueError("an interval has no neighbour: the table changed between two reads")
                continue
            x, y = a[3].decode(errors="replace"), b[3].decode(errors="replace")
            half = len(x) // 2
            pairs.append((a, b))
            sizes.append(len(x))
            edited.append((x[: len(x) - half] + y[:half]).encode())
        last = rows[-1]
        changed = [digest(h) for h in features(edited, ranks)]
        columns = [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([a[4] for a, _ in pairs], pa.string()),
            pa.array(changed, pa.string()),
            pa.array([likeness(a[4], c) for (a, _), c in zip(pairs, changed, strict=True)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        held, n = [], 0
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            text = row[3].as_py()
            held.append((*row[:3], text))
            n += len(text)
            if n > 1 << 21 or len(held) == 1024:
                yield compared(held)
                held, n = [], 0
        if held:
            yield compared(held)
    if last is not None and not last[1]:
        raise ValueError("an interval has no neighbour: the table changed between two reads")


def _digests(ranks: np.ndarray, batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            prints = [digest(h) for h in features([t.as_py() or b"" for t in part.column(1)], ranks)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs (doc_id, text); ranks as rarities() gives them, of these documents if absent."""
    ranks = rarities(docs) if ranks is None else ranks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(functools.partial(lean, _digests, ranks), "doc_id long, fingerprint string")


def compare_edited(docs: DataFrame, ranks: np.ndarray | None = None, shard_bytes: int = 24 << 20, most_shards: int = 100_000) -> DataFrame:
    """One row for each row of docs: its fingerprint, that of its edited text, and their likeness, and that to the next document.

    The edited text's last floor(n_chars / 2) code points are the first ones of the next document, or all of them; after the last
    document comes the first. Intervals hold about shard_bytes of text and grow beyond it once there are most_shards of
    them: the driver holds 25 bytes for each.
    """
    dealt = _neighbours(docs, shard_bytes, most_shards)
    if dealt is None:
        return docs.sparkSession.createDataFrame([], _RESULT)
    return dealt.mapInArrow(functools.partial(lean, _compare, rarities(docs) if ranks is None else ranks), _RESULT)


def op12_rare_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
