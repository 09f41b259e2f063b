"""Spelling variant grouping: words that differ by one code point, and the form that each is a variant of.

Near words are found by dynamic programming over sorted lists. A word is held against a sorted vocabulary from top to bottom: rows of the edit
matrix, three cells wide, are kept for each prefix length, so the next word of the list begins at the row of the prefix that it shares with the last one
(its LCP); where all cells of a row exceed one edit, all words that share that prefix are skipped at once.

One edit leaves the first half of a word or the rest of it alone. So a word searches only what begins with its first half in the
sorted vocabulary, and what ends with its other half in the vocabulary of reversed words; the second search leaves out what the first finds.
Both lists are cut into ranges of `range_words` words. A word goes to the ranges that its half meets, except those whose own
shared prefix is already more than one edit away, so that a range is a task's whole work, however many words a prefix has. Only counts and
the best neighbour of a word leave a task. No word has more than about 130 near words a code point, so no join here has a hot key.

Nulls, empties and repeats: a null text has no words; a null doc_id counts as an empty id; rows that share a doc_id all count. An empty table,
or one without words, gives no row. Further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import bounded, lean, store, table

SHORTEST, TIMES, DROPPED = 7, 10, 31
#: All words are of code points up to U+00FF; this one is above all of them.
_ABOVE = "Ā"
_LOWER = {k: k + 32 for k in range(65, 91)}
_FOUND = "word string, n_near long, best_n long, best string"
_FAR = 9


def _words(shortest: int, most: int, batches):
    """(word, n) of a task's texts, in blocks of at most about `most` words."""
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")
    counts: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts.keys()), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in Counter(run.findall((text.as_py() or b"").decode(errors="replace").translate(_LOWER))).items():
                h = zlib.crc32(word.encode(), seed)
                if h % DROPPED == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]  # noqa: PLW2901
                    if len(word) < shortest:
                        continue
                counts[word] += n
            if len(counts) > most:
                yield rows()
    yield rows()


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, some with a code point deleted by a checksum of document and run."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counted = rows.mapInArrow(functools.partial(lean, _words, shortest, 200_000), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def shared(a: str, b: str) -> int:
    """The length of the prefix that both have."""
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _next_row(row: tuple, word: str, depth: int, c: str) -> tuple:
    """The row of a prefix of depth + 1 from that of depth: edits to the word's prefixes one shorter, as long and one longer."""
    x, y, z = row
    n = len(word)
    a = min(x + (word[depth - 1] != c), y + 1) if depth <= n else _FAR
    b = min(y + (word[depth] != c), z + 1, a + 1) if depth < n else _FAR
    d = min(z + (word[depth + 1] != c), b + 1) if depth + 1 < n else _FAR
    return a, b, d


def within_reach(word: str, half: int, prefix: str) -> bool:
    """Whether what begins with the prefix, which has the word's first `half` code points, may be one edit from the word."""
    row = (1, 0, 1)
    for depth in range(half, len(prefix)):
        row = _next_row(row, word, depth, prefix[depth])
        if min(row) > 1:
            return False
    return True


def near(word: str, half: int, words: list[str], lcps: list[int]):
    """Places in the sorted list of the words that share the first `half` code points and are one edit away.

    lcps[k] is the prefix that words k - 1 and k share.
    """
    at, end = bisect_left(words, word[:half]), bisect_left(words, word[:half] + _ABOVE)
    rows = [(1, 0, 1)] * (len(word) + 4)  # by depth; rows up to `depth` hold for the word at hand
    depth, n = half, len(word)
    padded = word + "\0\0\0"  # nothing equals these, so cells behind the word cost an edit each
    while at < end:
        other = words[at]
        size = len(other)
        while depth < size:
            # _next_row, written out
            x, y, z = rows[depth]
            c = other[depth]
            a = x if padded[depth - 1] == c else x + 1
            if y < a:
                a = y + 1
            b = y if padded[depth] == c else y + 1
            if z < b:
                b = z + 1
            if a < b:
                b = a + 1
            d = z if padded[depth + 1] == c else z + 1
            if b < d:
                d = b + 1
            if a > 1 and b > 1 and d > 1:
                break
            depth += 1
            rows[depth] = a, b, d
        else:
            if -1 <= n - size <= 1 and rows[size][n - size + 1] == 1:
                yield at
            at += 1
            if at < end:
                depth = min(depth, lcps[at])
            continue
        at = bisect_left(words, other[: depth + 1] + _ABOVE, at, end)
        if at < end:
            depth = shared(other, words[at])
    return


def _ranges(range_words: int, batches):
    """First and last word of each range of a sorted part."""
    first = last = None
    n = 0
    for batch in batches:
        out = []
        for word in batch.column(0).to_pylist():
            if n == range_words:
                out.append((first, last))
                n = 0
            if not n:
                first = word
            last = word
            n += 1
        yield pa.RecordBatch.from_pydict({"first": pa.array([a for a, _ in out], pa.string()), "last": pa.array([b for _, b in out], pa.string())})
    if n:
        yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.string()), "last": pa.array([last], pa.string())})


def _deal(ranges: list[list[tuple[str, str]]], batches):
    """Each word to its own range of both lists, and as a query to the ranges that may hold a near word."""
    firsts = [[a for a, _ in r] for r in ranges]
    common = [[a[: shared(a, b)] for a, b in r] for r in ranges]
    for batch in batches:
        out = []
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for side in (0, 1):
                key = word[::-1] if side else word
                half = len(word) - len(word) // 2 if side else len(word) // 2
                base, starts = len(firsts[0]) * side, firsts[side]
                out.append((base + bisect_right(starts, key) - 1, 0, key, n))
                begin = key[:half]
                for k in range(max(0, bisect_right(starts, begin) - 1), bisect_left(starts, begin + _ABOVE)):
                    if ranges[side][k][1] >= begin and (len(common[side][k]) <= half or within_reach(key, half, common[side][k])):
                        out.append((base + k, 1, key, n))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["range", "query", "key", "n"])


def _scan(n_forward: int, batches):
    """What each query finds in its range: the number of near words and the best of them."""
    current, words, counts, lcps = None, [], [], None
    for batch in batches:
        out = []
        for k, query, key, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if k != current:
                current, words, counts, lcps = k, [], [], None
            if not query:
                words.append(key)
                counts.append(n)
                continue
            if lcps is None:
                lcps = [0, *(shared(a, b) for a, b in zip(words, words[1:], strict=False))]
            back = k >= n_forward
            half = len(key) - len(key) // 2 if back else len(key) // 2
            found = near(key, half, words, lcps)
            if back:
                word, begin = key[::-1], key[::-1][: len(key) // 2]
                best = [(-counts[j], w) for j in found if not (w := words[j][::-1]).startswith(begin)]
            else:
                word, best = key, [(-counts[j], words[j]) for j in found]
            if best:
                m, w = min(best)
                out.append((word, len(best), -m, w))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, range_words: int = 20_000) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near word; words is a stored table (word, n) of distinct words.

    The driver and each task hold the first and last word of each range: two words for range_words words of the table.
    """
    n = words.count()
    room = max(range_words, n // 100_000)
    ranges = []
    for key in (F.col("word"), F.reverse("word")):
        keys = words.select(key.alias("key")).repartitionByRange(max(1, -(-n // (50 * room))), "key").sortWithinPartitions("key")
        found = keys.mapInArrow(functools.partial(_ranges, room), "first string, last string").collect()
        ranges.append(sorted((r["first"], r["last"]) for r in found))
    total = max(1, sum(map(len, ranges)))
    # a word that its own range alone has to see moves twice, as an entry and as a query
    dealt = words.select("word", "n").mapInArrow(functools.partial(_deal, ranges), "range int, query int, key string, n long")
    dealt = dealt.repartitionById(total, F.col("range")).sortWithinPartitions("range", "query", "key")
    found = dealt.mapInArrow(functools.partial(lean, _scan, len(ranges[0])), _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, times: int = TIMES, range_words: int = 20_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word that occurs at least `least` times.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its most frequent near word (ties: the first in
    code-point order) if that occurs at least `times` as often; root is the last of the chain of forms. Chains double their steps each round;
    counts grow along them, so they end.
    """
    words = store(vocabulary(docs, shortest, least), "words")
    known = store(words.join(near_words(words, range_words), "word", "left").na.fill(0, ["n_near"]), "near")
    formed = F.col("best_n") >= times * F.col("n")
    known = known.select("word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    roots = store(known.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = bounded(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), 64)
        moved = roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = store(moved, "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
