"""Source divergence audit: how the words of each source of a language differ from those of its other sources and of the language.

Terms are counted by single-pass in-memory indexing. A task counts terms of its documents in memory, in one block of postings (term, language,
source; occurrences, documents). A full block is sorted by term, a run for each of its groups, cut by hash shards and handed on in chunks, and a new
block begins. A shard's chunks arrive group by group, in order of their first terms; a heap merges the runs that are open, and equal
terms become one frequency. A shard holds a chunk of each open run of one group. Keys are hashed with their language and source, so neither a
frequent word nor a large source lands in one shard.

Pairs of sources start from what two sources without any term would have, as most terms of a language are in neither. Then the postings
stream by in blocks (at most `BLOCK` sources against as many, some terms at a time), and each term present in one of them
adds the difference to that. Sums are 64-bit integers; no pair of postings leaves a task.

Nulls, empties and repeats: null text, lang and source are ''; each row is a document, whatever its doc_id; a group without terms counts with zeros;
a language without kept terms has pairs of value 0 and no term rows. An empty table gives no row. Further columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.llm.common import bounded, lean, store, table

#: Bytes of a UTF-8 text: letters in lower case, and what isn't ASCII; all others part terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SCALE = 1_000_000_000
#: Sources in a block of pairs, and postings that a block's part of the terms holds at most, about.
BLOCK, BLOCK_POSTINGS = 128, 400_000
_CHUNK, _TERMS = 512, 4096
_RUN = "shard int, low binary, lang string, source string, terms array<binary>, n array<long>, docs array<long>"
_FREQUENCY = "lang string, source string, term string, n long, docs long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _chunks(rows: list[tuple], terms: list[bytes], n: list[int], docs: list[int], ends: list[int]) -> pa.RecordBatch:
    """Chunks as a batch: (shard, low, lang, source) of each, and the postings of all with the ends of each."""
    offsets = pa.array([0, *ends], pa.int32())
    heads = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True)]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((terms, pa.binary()), (n, pa.int64()), (docs, pa.int64()))]
    return pa.RecordBatch.from_arrays([*heads, *lists], names=["shard", "low", "lang", "source", "terms", "n", "docs"])


def _index(most: int, shards: int, batches):
    """Runs of the blocks of one task, one for each group that a block holds; a block has about `most` postings."""
    block: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def run():
        rows, flat, ns, ds, ends = [], [], [], [], []
        while block:
            (lang, source), (n, docs) = block.popitem()
            seed = zlib.crc32(f"{len(lang)}:{lang}{source}".encode())
            parts: list[list[bytes]] = [[] for _ in range(shards)]
            for term in sorted(n):
                parts[zlib.crc32(term, seed) % shards].append(term)
            for shard, terms in enumerate(parts):
                for k in range(0, len(terms), _CHUNK):
                    some = terms[k : k + _CHUNK]
                    rows.append((shard, some[0], lang, source))
                    flat += some
                    ends.append(len(flat))
            ns += map(n.__getitem__, flat[len(ns) :])
            ds += map(docs.__getitem__, flat[len(ds) :])
            if len(flat) > 100_000:
                yield _chunks(rows, flat, ns, ds, ends)
                rows, flat, ns, ds, ends = [], [], [], [], []
        if rows:
            yield _chunks(rows, flat, ns, ds, ends)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = block.setdefault((lang, source), (Counter(), Counter()))
            words = terms_of(text.as_py() or b"")
            held -= len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n)
            if held > most:
                yield from run()
                held = 0
    yield from run()


def _merge(batches):
    """Frequencies of the shards, whose chunks come in order of shard, group and first term."""
    heap: list = []  # (term, number of its chunk, place in it, chunk)
    here, number = None, 0
    terms, ns, ds = [], [], []
    last, n, docs = None, 0, 0

    def drained(low):
        """Takes out all terms below `low`, or all."""
        nonlocal last, n, docs
        while heap:
            term, k, at, chunk = heap[0]
            if low is not None and term >= low:
                return
            some, a, b = chunk
            if term == last:
                n += a[at]
                docs += b[at]
            else:
                if last is not None:
                    terms.append(last)
                    ns.append(n)
                    ds.append(docs)
                last, n, docs = term, a[at], b[at]
            at += 1
            if at < len(some):
                heapq.heapreplace(heap, (some[at], k, at, chunk))
            else:
                heapq.heappop(heap)
        if low is None and last is not None:
            terms.append(last)
            ns.append(n)
            ds.append(docs)
            last = None

    def rows():
        """What is finished of the group at hand."""
        k = len(terms)
        text = pa.array(terms, pa.binary())
        try:
            text = text.cast(pa.string())
        except pa.ArrowInvalid:  # texts that aren't UTF-8
            text = pa.array([t.decode(errors="replace") for t in terms], pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array([here[1]] * k, pa.string()), pa.array([here[2]] * k, pa.string()), text, pa.array(ns, pa.int64()), pa.array(ds, pa.int64())], names=["lang", "source", "term", "n", "docs"])
        terms.clear()
        ns.clear()
        ds.clear()
        return batch

    for batch in batches:
        lists = batch.column("terms")
        ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
        a, b = (batch.column(c).flatten().to_numpy().tolist() for c in ("n", "docs"))
        for k, group in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "source")), strict=True)):
            x, y = ends[k], ends[k + 1]
            if group != here:
                drained(None)
                if terms:
                    yield rows()
                here = group
            else:
                drained(flat[x])
            number += 1
            heapq.heappush(heap, (flat[x], number, 0, (flat[x:y], a[x:y], b[x:y])))
            if len(terms) > 20_000:
                yield rows()
    drained(None)
    if terms:
        yield rows()


def frequencies(docs: DataFrame, block_postings: int = 500_000, shard_bytes: int = 32 << 20, most_shards: int = 16_384) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents of it that have it."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, min(most_shards, -(-total // shard_bytes)))
    runs = rows.mapInArrow(functools.partial(lean, _index, block_postings, shards), _RUN)
    dealt = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lang", "source", "low")
    return dealt.mapInArrow(functools.partial(lean, _merge), _FREQUENCY)


def _p(n: str, total: str) -> Column:
    """p = 1 + floor(SCALE * (n + 2) / total), in decimals."""
    return F.expr(f"1 + cast((cast({SCALE} as decimal(10, 0)) * cast({n} + 2 as decimal(19, 0))) div nullif({total}, 0) as bigint)")


def _f(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _corrections(key: tuple, rows: pa.Table) -> pa.Table:
    """(lang, source, other, value) of one block of pairs over some terms: what terms present add to pairs of absent ones."""
    lang, a, b = (k.as_py() for k in key[:3])
    member = rows.filter(pc.is_null(rows["term"]))
    names = sorted(zip(member["block"].to_pylist(), member["source"].to_pylist(), member["p0"].to_pylist(), strict=True))
    place = {s: k for k, (_, s, _) in enumerate(names)}
    none = np.array([p for _, _, p in names], np.int64)
    left = np.array([k for k, x in enumerate(names) if x[0] == a], int)
    right = np.array([k for k, x in enumerate(names) if x[0] == b], int)
    found = rows.filter(pc.is_valid(rows["term"]))
    terms = found["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(terms, kind="stable")
    terms, p = terms[order], found["p"].to_numpy()[order]
    at = np.array([place[s] for s in found["source"].to_pylist()], int)[order]
    value = np.zeros((len(left), len(right)), np.int64)

    def f(x, y):
        return (x - y) * (x - y) // (x + y)

    base = f(none[left][:, None], none[right][None, :])
    n_terms = int(terms[-1]) + 1 if len(terms) else 0
    for low in range(0, n_terms, _TERMS):
        x, y = np.searchsorted(terms, [low, low + _TERMS])
        n = min(_TERMS, n_terms - low)
        dense = np.repeat(none[None, :], n, axis=0)
        dense[terms[x:y] - low, at[x:y]] = p[x:y]
        other = np.ascontiguousarray(dense[:, right])
        for k, j in enumerate(left.tolist()):
            value[k] += f(dense[:, j : j + 1], other).sum(axis=0) - n * base[k]
    i, j = np.nonzero(left[:, None] < right[None, :] if a == b else np.ones(value.shape, bool))
    names = np.array([s for _, s, _ in names], object)
    one, two, v = names[left[i]], names[right[j]], value[i, j]
    columns = [pa.array([lang] * (2 * len(v)), pa.string()), pa.array([*one, *two], pa.string()), pa.array([*two, *one], pa.string()), pa.array(np.concatenate([v, v]))]
    return pa.Table.from_arrays(columns, names=["lang", "source", "other", "value"])


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language (all), and each source's `top` terms above its language.

    Terms that fewer than least_docs documents of the language have don't count. With p and q a term's smoothed share of two
    texts in billionths, its divergence is floor((p - q)^2 / (p + q)); a pair's value is the sum over all kept terms.
    """
    found = store(frequencies(docs), "frequencies")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs")
    kept = store(kept, "kept")
    counts = store(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(sums, ["lang", "source"], "left").join(F.broadcast(langs) if _few(langs) else langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = store(groups.withColumn("total", F.expr("total + 2 * v")).withColumn("lang_total", F.expr("lang_total + 2 * v")).withColumn("p0", _p("0", "total")), "groups")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    numbered = store(groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "numbered")
    posted = counts.join(bounded(numbered, 120), ["lang", "source"]).withColumn("p", _p("n", "total"))

    terms = posted.withColumn("q", _p("lang_n", "lang_total")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", place).where(F.col("rank") <= top)

    parts = max(1, -(-counts.count() // BLOCK_POSTINGS))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y")
    both = [F.least("block", "y").alias("a"), F.greatest("block", "y").alias("b")]
    shown = posted.select("lang", "source", "term", "p", "p0", "block", every, F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"))
    members = numbered.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "p0", "block", every).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = shown.unionByName(members.where("p0 is not null")).select("lang", *both, "part", "source", "term", "p", "p0", "block")
    corrections = tasks.groupBy("lang", "a", "b", "part").applyInArrow(_corrections, "lang string, source string, other string, value long")
    corrections = corrections.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    one = numbered.select("lang", "source", "p0", "v", every)
    two = numbered.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("block").alias("y"))
    pairs = one.join(two, ["lang", "y"]).where("source <> other").join(corrections, ["lang", "source", "other"], "left")
    total = F.coalesce(F.col("v") * _f("p0", "q0"), F.lit(0)) + F.coalesce("value", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), total.alias("value"))
    pairs = pairs.withColumn("rank", place)
    return pairs.unionByName(terms)


def _few(df: DataFrame) -> bool:
    return df.count() <= 50_000


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.lang_n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), s AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 2)) // (sum(lang_n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS q FROM c
), x AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 10
"""
