"""Benchmark decontamination by spaced seeds.

A seed hashes the tokens of a mask and ignores those between, so it survives substitutions there. The
three masks together meet every window of WINDOW tokens in which at most a fifth is substituted, and every
shorter item down to SHORTEST tokens likewise (tests/llm checks all patterns).

Seeds of items and of documents are joined. A Bloom filter of the items' seeds, of bounded size, keeps most of the
documents' seeds from the shuffle; seeds that very many documents hold are dealt to several tasks. The
join yields pairs of a document and an item, which are then laid side by side at each offset that a seed names.

A document is contaminated by an item if, at one offset, some WINDOW tokens of the item in a row (all of
a shorter item) agree with the document in four fifths or more of the places.

Tokens are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import bounded, column, fresh, hot_join, lean, store, table
from threadloom.llm.shingles import PUNCTUATION, mix, word_hashes

#: Positions of each mask that count.
MASKS = ((0, 1, 2, 4, 5), (0, 2, 6, 7, 8), (0, 1, 4, 6, 7))
WINDOW, SHORTEST, SHARE = 20, 8, 0.8
PROBES = 3
#: Pairs of one document that are verified at once.
PAIRS_AT_ONCE = 64


def tokens(text: bytes) -> np.ndarray:
    return word_hashes(text, PUNCTUATION)


def seeds(words: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    n = max(0, len(words) - mask[-1])
    acc = np.full(n, salt + 1, np.uint64)
    for k in mask:
        acc = acc * np.uint64(0x2545F4914F6CDD1D) + words[k : k + n]
        acc ^= acc >> np.uint64(31)
    return mix(acc)


def all_seeds(words: np.ndarray) -> np.ndarray:
    return np.concatenate([seeds(words, mask, m) for m, mask in enumerate(MASKS)])


def agreement(item: np.ndarray, words: np.ndarray, start: int) -> int | None:
    """Tokens in which the item, laid at `start` of the document, agrees; None if no window agrees enough."""
    a, b = max(0, -start), min(len(item), len(words) - start)
    if b <= a:
        return None
    same = np.zeros(len(item), np.int64)
    same[a:b] = item[a:b] == words[start + a : start + b]
    window = min(WINDOW, len(item))
    total = np.concatenate([[0], np.cumsum(same)])
    if (total[window:] - total[:-window]).max() * 5 < 4 * window:
        return None
    return int(total[-1])


def offsets(item: np.ndarray, words: np.ndarray) -> list[int]:
    """Where the item may lie in the document: the offsets that a common seed names, each once, ascending."""
    found: set[int] = set()
    for m, mask in enumerate(MASKS):
        a, b = seeds(item, mask, m), seeds(words, mask, m)
        order = np.argsort(a, kind="stable")
        a = a[order]
        lo, hi = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
        at = np.flatnonzero(hi > lo)
        for k in range(0, len(at), 4096):  # a repeated seed has many offsets, most of them the same
            part = at[k : k + 4096]
            n = hi[part] - lo[part]
            hit = np.repeat(lo[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.update(np.unique(np.repeat(part, n) - order[hit]).tolist())
    return sorted(found)


def best_offset(item: np.ndarray, words: np.ndarray) -> tuple[int, int] | None:
    """(agreeing tokens, offset) at the offset that agrees most, the first of equals; None for a clean document."""
    best = None
    for start in offsets(item, words):
        same = agreement(item, words, start)
        if same is not None and (best is None or same > best[0]):
            best = same, start
    return best


def _item_seeds(batches):
    """(item, item_id, tokens, seeds) of the items that are long enough; item is a number that stands for id and text."""
    for batch in batches:
        out = {"item": [], "item_id": [], "tokens": [], "seeds": []}
        for item, i, x in zip(*(batch.column(k) for k in range(3)), strict=True):
            words = tokens(x.as_py() or b"")
            if len(words) >= SHORTEST:
                for c, v in zip(out.values(), (item.as_py(), i.as_py(), words.view(np.int64), np.unique(all_seeds(words)).view(np.int64)), strict=True):
                    c.append(v)
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_pydict({c: pa.array(v, lists if c in ("tokens", "seeds") else pa.int64()) for c, v in out.items()})


def _probe(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (keys >> np.uint64(7 * k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - bits.bit_length())


def _document_seeds(shared, bits: int, batches):
    """(doc_id, text_hash, seed): each document's distinct seeds that the items' filter holds."""
    held = np.frombuffer(shared.value, np.uint8)
    for batch in batches:
        ids, hashes, found = [], [], []
        for i, h, x in zip(*(batch.column(k) for k in range(3)), strict=True):
            keys = all_seeds(tokens(x.as_py() or b""))
            for k in range(PROBES):
                at = _probe(keys, k, bits)
                keys = keys[held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 != 0]
            if len(keys):
                keys = np.unique(keys)
                ids += [i.as_py()] * len(keys)
                hashes += [h.as_py()] * len(keys)
                found.append(keys.view(np.int64))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text_hash": pa.array(hashes, pa.int64()), "seed": np.concatenate([np.empty(0, np.int64), *found])})


def _verify(batches):
    for batch in batches:
        rows = []
        for i, h, x, items in zip(*(batch.column(k) for k in range(4)), strict=True):
            words = tokens(x.as_py() or b"")
            for item in items.as_py():
                item_words = np.array(item["tokens"], np.int64).view(np.uint64)
                if best := best_offset(item_words, words):
                    rows.append((i.as_py(), h.as_py(), item["item_id"], best[0], len(item_words), max(0, best[1])))
        names = ["doc_id", "text_hash", "item_id", "n_matched", "n_tokens", "position"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def _filter(item_seeds: DataFrame, most_bits: int):
    """(the broadcast Bloom filter of a table of seeds, its bits): at least 64 bits a seed, as long as they are at most most_bits."""
    bits, n = 1 << 16, item_seeds.count()
    while bits < most_bits and bits < 64 * n:
        bits *= 2

    def marked(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_probe(keys, k, bits) for k in range(PROBES)]))
            yield pa.RecordBatch.from_pydict({"word": (at >> np.uint64(5)).view(np.int64), "bit": np.int64(1) << (at & np.uint64(31)).view(np.int64)})

    # at most a row for 32 bits of the filter comes to the driver
    words = item_seeds.select("seed").mapInArrow(marked, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    held = np.zeros(bits // 32, "<u4")
    for row in words.toLocalIterator():
        held[row["word"]] = row["bits"]
    return item_seeds.sparkSession.sparkContext.broadcast(held.tobytes()), bits


def _found(docs: DataFrame, benchmark: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_tokens, position), a row for each distinct document, text and item."""
    binary = F.col("text").cast("binary")
    known = benchmark.where("item_id is not null and text is not null").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), binary.alias("text")).dropDuplicates(["item"])
    items = store(known.mapInArrow(functools.partial(lean, _item_seeds), "item long, item_id long, tokens array<long>, seeds array<long>"), "items")
    item_seeds = store(items.select("item", F.explode("seeds").alias("seed")), "item-seeds")
    shared, bits = _filter(item_seeds, most_bits)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), binary.alias("text"))
    key = ["doc_id", "text_hash"]
    # a null doc_id is a value like any other, so joins compare a number that stands for the whole key
    hits = store(rows.mapInArrow(functools.partial(lean, _document_seeds, shared, bits), "doc_id long, text_hash long, seed long"), "hits")
    seen = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    of_seed = store(item_seeds.join(seen, "seed"), "seeds-met")
    pairs = store(hot_join(hits, of_seed, "seed", "n", 64).select(*key, "item").distinct(), "pairs")

    sizes = store(pairs.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / PAIRS_AT_ONCE).alias("chunks")), "documents-met")
    chunk = F.pmod(F.xxhash64("item"), F.col("chunks")).alias("chunk")
    dealt = pairs.alias("p").join(bounded(sizes, 32).alias("s"), F.expr("p.text_hash = s.text_hash and p.doc_id <=> s.doc_id")).select("p.doc_id", "p.text_hash", "p.item", chunk)
    # all items fit beside a block of documents if their tokens, 8 bytes each, are few; else each goes to the documents that it may be in
    n_items, n_tokens = items.agg(F.count(F.lit(1)), F.sum(F.size("tokens").cast("long"))).first()
    item_rows = store(items.join(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item").select("item", F.struct("item_id", "tokens").alias("it"), "n"), "items-met")
    chunks = hot_join(dealt, item_rows, "item", "n", 64 + 8 * -(-(n_tokens or 0) // max(1, n_items))).groupBy(*key, "chunk").agg(F.collect_list("it").alias("items"))
    met = bounded(sizes.select(*key), 24).alias("m")
    texts = rows.alias("r").join(met, F.expr("r.text_hash = m.text_hash and r.doc_id <=> m.doc_id"), "left_semi").dropDuplicates(key)
    ready = texts.alias("t").join(chunks.alias("c"), F.expr("t.text_hash = c.text_hash and t.doc_id <=> c.doc_id")).select("t.doc_id", "t.text_hash", "t.text", "c.items")
    return store(ready.mapInArrow(functools.partial(lean, _verify), "doc_id long, text_hash long, item_id long, n_matched long, n_tokens long, position long"), "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """(doc_id, item_id, n_matched, n_tokens, position): the items found in each document, at their best offset.

    position is the document's token that the item's first one lies on, 0 if the item begins before the text does.
    Clean documents give no row. Nulls and empties: null texts hold nothing, null item_ids are left
    out, a null doc_id is reported as null; items of fewer than SHORTEST tokens aren't searched, as they
    would meet clean texts. Rows of equal doc_id and text are reported once, items of equal id and different texts
    each. Further columns are ignored; empty tables give no row.
    """
    return _found(docs, benchmark, most_bits).drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most_bits: int = 1 << 28) -> DataFrame:
    """docs, all columns, without the rows whose text holds an item; what else holds as for contaminated()."""
    gone = store(_found(docs, benchmark, most_bits).select("doc_id", "text_hash").distinct(), "gone")
    a, b = fresh(docs, "id", "hash")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64("text") == F.col(b))
    return docs.join(bounded(gone.toDF(a, b), 24), same, "left_anti").select(*map(column, docs.columns))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
