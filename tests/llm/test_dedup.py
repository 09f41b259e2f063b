from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, components, decontamination, line_dedup, minhash, shingles


def _shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < size else frozenset(zip(*(w[k:] for k in range(size)), strict=False))


def _components(rows, size, percent):
    sets = {i: _shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 25)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    got = {r[0]: (r[1], r[2]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=2).collect()}
    assert got == _components(rows, 2, 80)


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, size=2).collect()
    assert len(rows) == 14
    by = {(r["doc_id"], r["n_shingles"]): r for r in rows}
    assert all(r["component_id"] == 1 and r["kept"] == (r["doc_id"] == 1) for r in rows if r["doc_id"] in (1, 2, 3))
    assert by[4, 0]["component_id"] == 4 and by[5, 0]["kept"] and by[6, 0]["kept"] and by[7, 1]["component_id"] == 7
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (5, text + " more"), (5, "a text that nobody else has got at all"), (5, "a text that nobody else has got at all"), (7, text), (None, text), (None, text), (8, None), (8, None), (9, "x " * 50), (9, "x " * 51)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, `__hash` int").repartition(4)
    got = minhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r[0] or 0, r[1] or "") for r in got.collect()), key=str)[:-1] == sorted([(1, text), (5, "a text that nobody else has got at all"), (0, text), (0, text), (8, ""), (8, "")], key=str) and got.count() == 7


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id) as k", "id as v")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("k") * 2)
    want = sorted(map(tuple, left.join(right, "k").select("k", "v", "w").collect()))
    for row_bytes in (8, 1 << 20):
        got = common.hot_join(left, right, "k", "n", row_bytes, least=50)
        assert got.columns == ["k", "v", "w"] and sorted(map(tuple, got.collect())) == want


def test_estimate_is_close(spark):
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        x = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
        k = int(2000 * (1 - share) / (1 + share))
        y = np.concatenate([x[k:], rng.integers(0, 1 << 62, k).astype(np.uint64)])
        a, b = (minhash.sketch(np.unique(z), 40, 5)[0] for z in (x, y))
        df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
        got = df.select(minhash.estimate(minhash.mismatches(F.col("a"), F.col("b")), 200)).first()[0]
        assert abs(got - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.13


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 300: 300, 301: 300}


def test_words_and_shingles():
    assert len(shingles.word_hashes(b"")) == len(shingles.word_hashes(b" \n\t")) == 0
    a, b = shingles.word_hashes(b"The cat  the\tCAT"), shingles.word_hashes("the cat é".encode())
    assert a[0] == a[2] == b[0] and a[1] == a[3] == b[1] and len(b) == 3
    assert len(shingles.shingle_hashes(a, 2)) == 2 and len(shingles.shingle_hashes(a[:1], 2)) == 1
    long = shingles.word_hashes(b"ab " * 100_000)
    assert len(long) == 100_000 and len(set(long.tolist())) == 1


def _plain_lines(rows, shortest=10):
    keys = {}
    parsed = []
    for i, t in rows:
        lines = (t or "").split("\n")
        marks = []
        for line in lines:
            k = line.strip(" \t\n\r\x0b\x0c")
            k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
            marks.append(k if len(k) >= shortest else None)
            if len(k) >= shortest:
                keys.setdefault(k, set()).add(i)
        parsed.append((i, lines, marks))
    out = []
    for i, lines, marks in parsed:
        kept = [x for x, k in zip(lines, marks, strict=True) if k is None or len(keys[k]) < 2 or i == min(keys[k])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_matches_plain_version(spark):
    rng = random.Random(2)
    pool = [f"line number {k} of the pool" for k in range(60)] + ["short", "", "  Line number 3 OF the pool\t"]
    rows = [(n, None if n % 17 == 0 else "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for n in range(200)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == _plain_lines(rows)


def test_line_dedup_of_odd_rows(spark, odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    rows = {(r["doc_id"], r["n_lines"]): r for r in out.collect()}
    assert out.count() == 14 and set(out.columns) == {*odd_docs.columns, "n_dropped"}
    assert rows[10, 4]["text"] == "kurz\n\nZeile drei ist auch lang" and rows[9, 3]["n_dropped"] == 0
    assert all(r["text"] == "" and r["n_dropped"] == 1 for r in out.where("doc_id in (1, 2)").collect())  # the row without an id comes first
    assert rows[4, 1]["text"] == "" and rows[5, 1]["text"] == ""
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_a_crowded_filter_changes_nothing(spark, monkeypatch):
    rows = [(n, f"document {n} has its own line\nand a line of pair {n // 2}") for n in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _plain_lines(rows)
    monkeypatch.setattr(line_dedup, "HASHES", 1)
    got = line_dedup.dedup_lines(df, bits_per_line=1)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == want


@pytest.mark.parametrize("n,k", [(20, 4), (19, 3), (18, 3), (17, 3), (16, 3), (15, 3), (14, 2), (13, 2), (12, 2), (11, 2), (10, 2), (9, 1), (8, 1)])
def test_masks_meet_every_pattern_of_substitutions(n, k):
    places = [{o + x for x in mask} for mask in decontamination.MASKS for o in range(n - mask[-1])]
    for gone in itertools.combinations(range(n), k):
        assert any(not p.intersection(gone) for p in places), gone


def test_decontamination_matches_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([5, 9, 15, 25, 40])))) for k in range(20)] + [(None, "a b c d e f g h i j"), (30, None), (31, "")]
    docs = []
    for n in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if n % 3 == 0:
            item = rng.choice(items[:20])[1].split()
            for _ in range(rng.randint(0, len(item) // 3)):
                item[rng.randrange(len(item))] = rng.choice(words)
            text += item + [rng.choice(words) for _ in range(20)]
        docs.append((n, " ".join(text).upper() if n % 2 else ", ".join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = set()
    for i, item in items:
        w = decontamination.tokens((item or "").encode())
        for d, text in docs:
            t = decontamination.tokens(text.encode())
            if i is not None and len(w) >= 8:
                best = max((a for s in range(-len(w), len(t)) if (a := decontamination.agreement(w, t, s)) is not None), default=None)
                if best is not None:
                    want.add((d, i, best))
    for most_bits in (1 << 28, 4):  # a crowded filter, too
        got = decontamination.contaminated(df, benchmark, most_bits)
        assert {(r["doc_id"], r["item_id"], r["n_matched"]) for r in got.collect()} == want
        clean = decontamination.drop_contaminated(df, benchmark, most_bits)
        assert {r[0] for r in clean.select("doc_id").collect()} == {n for n, _ in docs} - {d for d, _, _ in want}
    assert len(want) > 10
    kept = decontamination.drop_contaminated(odd_docs, benchmark)
    assert kept.count() == 14 and kept.columns == odd_docs.columns
    assert decontamination.contaminated(no_docs, benchmark).count() == 0
    assert decontamination.contaminated(odd_docs, benchmark.limit(0)).count() == 0


def test_an_item_of_very_many_documents_is_dealt_to_several_tasks(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    items = [" ".join(rng.sample(words, 40)) for _ in range(6)]
    docs = [(k, " ".join(rng.sample(words, 30)) + " " + (items[0] if k % 4 else items[k % 6]) + " end") for k in range(80)] + [(99, "clean text of a few words")]
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(map(tuple, decontamination.contaminated(*tables).collect()))
    monkeypatch.setattr(decontamination, "hot_join", lambda a, b, key, count, _: common.hot_join(a, b, key, count, 1 << 30, least=5))
    assert sorted(map(tuple, decontamination.contaminated(*tables).collect())) == want and len(want) == 80
