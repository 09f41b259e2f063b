"""Near-duplicates by b-bit MinHash.

A document is its set of word shingles. Equal sets are one node from the start, so copies cost one
row each. A node has `bands` x `rows` minima: each band of them is a bucket, and of every minimum the
low bits are kept in packed words, whose differing groups a bit count finds. Of the two nodes of a
candidate pair, the estimate (corrected for chance agreement of so few bits) must come within
`margin` of the threshold; then the full sets decide.

A bucket isn't expanded into pairs. First each node is held against the bucket's least node; what
that links is joined into components. Buckets that still span several components are pooled by their largest
component, so nodes that meet in many buckets meet once; each node outside it is held against
the pool in blocks of bounded size, signatures first and then full sets, and one link to a component
is enough. So every two nodes of a bucket end in one component or are compared, and no pair leaves a task
but links.

At the default 40 bands of 5, a pair at 0.8 shares no bucket once in ten million pairs.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import bounded, fresh, hot_join, lean, store, table
from threadloom.llm.components import components
from threadloom.llm.shingles import mix, shingle_hashes, word_hashes

BITS = 4
_PER_WORD = 64 // BITS
_BLOCK, _MINOR, _BLOCK_SHINGLES = 512, 256, 200_000
_rng = np.random.default_rng(77)
_FACTORS = _rng.integers(0, 1 << 31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, 4096, dtype=np.uint32)
NODE = "node binary, n_shingles long, signature array<long>, buckets array<long>"


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(low, (x[k : k + 512, None] * _FACTORS[:n] + _OFFSETS[:n]).min(axis=0), out=low)
    return mix(low.astype(np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(1 << 32))


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mix(hashes).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def sketch(hashes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, bucket of each band)"""
    n = bands * rows
    m = minima(hashes, n)
    words = -(-n // _PER_WORD)
    low = np.zeros(words * _PER_WORD, np.uint64)
    low[:n] = m & np.uint64((1 << BITS) - 1)
    shifts = np.arange(_PER_WORD, dtype=np.uint64) * np.uint64(BITS)
    packed = np.bitwise_or.reduce(low.reshape(words, _PER_WORD) << shifts, axis=1)
    acc = np.arange(bands, dtype=np.uint64)
    for column in m.reshape(bands, rows).T:
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + column)
    return packed.view(np.int64), acc.view(np.int64)


def _sketches(size: int, bands: int, rows: int, batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            out = {"node": [], "n_shingles": [], "signature": [], "buckets": []}
            for x in part.column(1):
                h = shingle_hashes(word_hashes(x.as_py() or b""), size)
                a, b = sketch(h, bands, rows) if len(h) else (np.empty(0, np.int64),) * 2
                for c, v in zip(out.values(), (set_key(h), len(h), a, b), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column(0), "text_hash": part.column(2), "node": pa.array(out["node"], pa.binary()), "n_shingles": out["n_shingles"], "signature": pa.array(out["signature"], pa.list_(pa.int64())), "buckets": pa.array(out["buckets"], pa.list_(pa.int64()))}
            )


def _sets(size: int, batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_hashes(word_hashes(x.as_py() or b""), size) for x in part.column(1)]
            yield pa.RecordBatch.from_pydict({"node": pa.array([set_key(h) for h in sets], pa.binary()), "hashes": pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))})


def mismatches(a: Column, b: Column) -> Column:
    """Of two packed signatures, how many groups of bits differ."""
    ones = sum(1 << k for k in range(0, 64, BITS))

    def groups(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for step in (1, 2, 4, 8, 16):
            if step < BITS:
                d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    return F.aggregate(F.zip_with(a, b, groups), F.lit(0), lambda n, x: n + x)


def estimate(differing: Column, n: int) -> Column:
    """Similarity, corrected for minima whose low bits agree by chance."""
    chance = 2.0**-BITS
    return (1 - differing / n - chance) / (1 - chance)


def _blocks(n: int, percent: int, margin: float, batches):
    """Links of a block: each minor node against all nodes of other components, likeliest first, one a component."""
    least = percent / 100 - margin
    for batch in batches:
        out = []
        for row in batch.column("members"):
            members = row.as_py()
            minor = [m for m in members if m["minor"]]
            others = [m for m in members if not m["minor"]]
            if not minor or not others:
                continue
            a, b = (np.array([m["signature"] for m in x], np.int64).view(np.uint64) for x in (minor, others))
            sets = [np.array(m["hashes"], np.int64) for m in others]
            sizes = np.array([len(h) for h in sets])
            for k, m in enumerate(minor):
                d = a[k] ^ b
                for step in (1, 2, 4, 8, 16):
                    if step < BITS:
                        d |= d >> np.uint64(step)
                differing = np.bitwise_count(d & np.uint64(sum(1 << s for s in range(0, 64, BITS)))).sum(axis=1)
                similar = (1 - differing / n - 2.0**-BITS) / (1 - 2.0**-BITS)
                own, linked = np.array(m["hashes"], np.int64), {m["root"]}
                likely = np.flatnonzero((similar >= least) & (np.minimum(sizes, len(own)) * 100 >= np.maximum(sizes, len(own)) * percent))
                for j in likely[np.argsort(-similar[likely], kind="stable")].tolist():
                    if others[j]["root"] not in linked:
                        common = len(np.intersect1d(own, sets[j], assume_unique=True))
                        if common * 100 >= (len(own) + sizes[j] - common) * percent:
                            linked.add(others[j]["root"])
                            out.append((m["node"], others[j]["node"]))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})


def _groups(docs: DataFrame, size: int, threshold: float, bands: int, rows: int, margin: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n_shingles, node) of each row, and (node, component_id, group) of the nodes that aren't alone."""
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    percent = round(threshold * 100)
    sketched = store(rows_.withColumn("text_hash", F.xxhash64(F.col("text").cast("string"))).mapInArrow(functools.partial(lean, _sketches, size, bands, rows), f"doc_id long, text_hash long, {NODE}"), "sketches")
    known = sketched.where("n_shingles > 0 and doc_id is not null")
    nodes = store(known.groupBy("node").agg(F.min(F.struct("doc_id", "n_shingles", "signature", "buckets")).alias("x"), F.count(F.lit(1)).alias("copies")).select("node", "x.*", "copies"), "nodes")
    slim = nodes.select("node", "n_shingles", "signature")

    buckets = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = store(buckets.join(shared, "bucket"), "members")

    def likely(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose sizes and signatures allow a link."""
        two = pairs.join(slim.toDF("a", "na", "sa"), "a").join(slim.toDF("b", "nb", "sb"), "b")
        return two.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).where(estimate(mismatches(F.col("sa"), F.col("sb")), bands * rows) >= threshold - margin).select("a", "b")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The full sets (node, hashes) of some nodes, from one document's text each."""
        wanted = store(wanted.distinct().join(nodes.select("node", "doc_id"), "node"), "wanted")
        texts = rows_.join(bounded(wanted.select("doc_id").distinct(), 16), "doc_id", "left_semi").select("doc_id", "text")
        sets = texts.mapInArrow(functools.partial(lean, _sets, size), "node binary, hashes array<long>").join(bounded(wanted.select("node"), 32), "node", "left_semi")
        return store(sets.dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose full sets are similar enough."""
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
        common = F.size(F.array_intersect("ha", "hb"))
        return both.where(common * 100 >= (F.size("ha") + F.size("hb") - common) * percent).select("a", "b")

    pairs = store(likely(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()), "pairs")
    links = store(confirmed(pairs), "confirmed")
    roots = components(links)

    # buckets that span several components, pooled by their largest one
    labelled = store(members.where("n > 2").join(roots.select("node", "root"), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "labelled")
    by_root = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    open_ = by_root.groupBy("bucket").agg(F.max(F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("k").alias("n")).where("roots > 1")
    open_ = store(open_, "open")
    pooled = hot_join(labelled, open_, "bucket", "n", 128).select(F.col("main.root").alias("pool"), "node", "root").distinct()
    pooled = store(pooled.join(slim, "node").withColumn("minor", F.col("root") != F.col("pool")), "pooled")
    full = F.greatest(F.ceil(F.count(F.lit(1)) / _BLOCK), F.ceil(F.sum("n_shingles") / _BLOCK_SHINGLES))
    few = F.greatest(F.ceil(F.count_if("minor") / _MINOR), F.ceil(F.sum(F.when(F.col("minor"), F.col("n_shingles"))) / _BLOCK_SHINGLES))
    sizes = store(pooled.groupBy("pool").agg(full.alias("chunks"), few.alias("minors"), F.count(F.lit(1)).alias("n")), "pools")
    wide = hot_join(pooled, sizes, "pool", "n", 64).join(sets_of(pooled.select("node")), "node")
    own, own_minor = F.pmod(F.xxhash64("node"), F.col("chunks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("minors"))
    payload = ["pool", "node", "root", "signature", "hashes"]
    #: a node goes to its own chunk once for each group of minor nodes; a minor node to its group once for each chunk
    spread = wide.select(*payload, own.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)).alias("y"), F.lit(False).alias("minor")).unionAll(
        wide.where("minor").select(*payload, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("x"), own_minor.alias("y"), F.lit(True).alias("minor"))
    )
    blocks = spread.groupBy("pool", "x", "y").agg(F.collect_list(F.struct("node", "root", "signature", "hashes", "minor")).alias("members")).select("members")
    more = store(blocks.mapInArrow(functools.partial(lean, _blocks, bands * rows, percent, margin), "a binary, b binary"), "confirmed")
    roots = components(links.unionAll(more))

    least = nodes.select("node", "doc_id").join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = roots.join(least, "root").select("node", "component_id", F.col("root").alias("group"))
    alone = nodes.where("copies > 1").join(roots, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"), F.col("node").alias("group"))
    named = sketched.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("node"))).alias("node"))
    return named, linked.unionAll(alone)


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 5, margin: float = 0.2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row of docs (doc_id, text).

    Documents are linked if their shingle sets' similarity is at least `threshold`; component_id is
    the least doc_id reachable by links, and the document that carries it is kept.

    Nulls, empties and repeats: a text without words has no shingles and links with nothing; a null
    doc_id links with nothing, has a null component_id and is kept; rows that repeat a doc_id all
    return. Of rows that share a doc_id and differ in text, each follows its own text; text_hash tells
    them apart. Further columns of docs are ignored, and an empty table gives no row.
    """
    named, groups = _groups(docs, size, threshold, bands, rows, margin)
    out = named.join(groups, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 40, rows: int = 5, margin: float = 0.2) -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates.

    It is the row of the least doc_id, and of rows that share it, of the least text hash; of rows equal in doc_id
    and text one stays. Rows without a doc_id and rows without words all stay. Links are those of near_duplicates().
    """
    named, groups = _groups(docs, size, threshold, bands, rows, margin)
    members = store(named.join(groups, "node").select("doc_id", "text_hash", "group"), "members-of-groups")
    first = store(members.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n")), "first-of-groups")
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = store(hot_join(members, first, "group", "n", 64).where(~stays).select("doc_id", "text_hash").distinct(), "gone")
    again = store(members.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeated")
    out = _among(docs, gone, "left_anti")
    if again.isEmpty():
        return out
    # rows that are equal in doc_id and text
    (text_hash,) = fresh(out, "hash")
    one = _among(out, again, "left_semi").withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash]).drop(text_hash)
    return _among(out, again, "left_anti").unionAll(one)


def _among(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    a, b = fresh(docs, "id", "hash")
    return docs.join(bounded(rows.toDF(a, b), 24), (F.col("doc_id").cast("long") == F.col(a)) & (F.xxhash64("text") == F.col(b)), how)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2).drop("text_hash")
