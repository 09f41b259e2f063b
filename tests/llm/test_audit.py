from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from threadloom.llm import rare_digest, source_audit, spelling


def _documents(rng, n):
    """Rows with hot words, hot sources, null columns, empty texts and repeated rows."""
    words = ["alpha", "Beta", "gamma", "Größe", "élan", "日本", "x", "The", "the", "delta9", "e-mail", "ß", "omega"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words[: rng.choice((13, 73))]) for _ in range(rng.choice((0, 1, 5, 40))))
        rows.append((k // 2, rng.choice([text, text, text, None]), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", None, "d\0e"]), 7, "t"))
    return rows + [(1000, "rare words only", "fr", "a", 7, "t"), (1001, None, "fr", "b", 7, "t")] + rows[:3]


SCHEMA = "doc_id long, text string, lang string, source string, p long, term string"


@pytest.mark.parametrize(("n", "block", "postings"), [(150, 128, 200_000), (400, 2, 40)])
def test_audit_matches_sql(spark, monkeypatch, n, block, postings):
    """Also with tiny blocks of sources, of terms and of the index."""
    rows = [r for r in _documents(random.Random(n), n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(source_audit, "BLOCK_POSTINGS", postings)
    frequencies = source_audit.frequencies
    monkeypatch.setattr(source_audit, "frequencies", lambda d: frequencies(d, postings, 500))
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = con.sql(source_audit.OP11_SQL).fetchall()
    got = source_audit.audit(docs, block=block).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[2] for r in want} == {"pair", "term"}
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_frequencies_are_whole(spark):
    rng = random.Random(3)
    rows = _documents(rng, 200)
    want, has = Counter(), Counter()
    for _, text, lang, source, *_ in rows:
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        key = (lang or "", source or "")
        want.update((*key, w) for w in found)
        has.update((*key, w) for w in set(found))
    got = source_audit.frequencies(spark.createDataFrame(rows, SCHEMA).repartition(4), block_postings=25, shard_bytes=1000).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == {k: (n, has[k]) for k, n in want.items()} and len(got) == len(want)


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    rows = source_audit.audit(odd_docs).collect()
    assert rows and {r["part"] for r in rows} == {"pair"} and all(r["value"] == 0 for r in rows)
    assert ("", "a.com") not in {(r["lang"], r["source"]) for r in rows}
    assert source_audit.audit(no_docs).count() == 0


def test_entropies_are_those_of_the_windows():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 104, 200), np.full(60, 32), rng.integers(0, 256, 100)]).astype(np.uint8)
    got = rare_digest.entropies(data)
    for k in range(len(data) - rare_digest.WINDOW + 1):
        p = np.bincount(data[k : k + 32]) / 32
        p = p[p > 0]
        assert abs(got[k] - 1000 * -(p * np.log2(p)).sum() / 5) <= 1.5
    assert len(rare_digest.entropies(data[:31])) == 0


def _plain_features(text, ranks):
    """The definition, window by window."""
    n, w = len(text) - rare_digest.WINDOW + 1, rare_digest.WINDOW
    keys = []
    for k in range(max(0, n)):
        e = int(rare_digest.entropies(np.frombuffer(text[k : k + w], np.uint8))[0])
        keys.append((int(ranks[e]), k) if e >= rare_digest.LEAST else None)
    named = Counter()
    for k in range(-w + 1, n):
        some = [x for x in keys[max(0, k) : k + w] if x]
        if some:
            named[min(some)[1]] += 1
    out = []
    for k in sorted(k for k, m in named.items() if m >= rare_digest.NAMED):
        if text[k : k + w] not in out:
            out.append(text[k : k + w])
    return out


def test_features_are_the_same_in_buffers_and_segments(monkeypatch):
    rng = random.Random(8)
    ranks = np.random.default_rng(4).permutation(1001).astype(np.int32)
    texts = ["".join(rng.choice("abcdefghij klmn   op") for _ in range(rng.choice((0, 5, 31, 32, 33, 90, 700)))).encode() for _ in range(40)]
    texts += [b" " * 500, b"", texts[3] * 20, ("z" * 200 + "Größe 日本" * 30).encode()]
    whole = rare_digest.features(texts, ranks)
    monkeypatch.setattr(rare_digest, "_SEGMENT", 100)
    parts = rare_digest.features(texts, ranks)
    for text, a, b in zip(texts, whole, parts, strict=True):
        want = _plain_features(text, ranks)
        assert a.tolist() == b.tolist() == rare_digest.features([text], ranks)[0].tolist()
        small = {text[k : k + 8] for k in range(len(text) - 7)} if len(text) <= 64 else set()
        assert len(a) >= len(want) + len(small) and (len(text) > 64 or len(a) == len(want) + len(small) or len(text) < 8 and len(a) == 1)
        assert len(text) < rare_digest.SHORT or len(a) == max(1, len(want))


def test_likeness():
    ranks = np.arange(1001, dtype=np.int32)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    a, b = (" ".join(word() for _ in range(3000)) for _ in range(2))
    prints = [rare_digest.digest(h) for h in rare_digest.features([t.encode() for t in (a, b, a[: len(a) // 2] + b[: len(b) // 2], a.replace("e", "3", 5), "")], ranks)]
    like = lambda i, j: rare_digest.likeness(prints[i], prints[j])
    assert like(0, 0) == 1 and like(0, 1) == 0 and 0.4 < like(0, 2) < 0.6 and 0.4 < like(1, 2) < 0.62 and like(0, 3) > 0.9
    assert like(0, 4) == 0 and like(4, 4) == 1 and like(0, 2) == like(2, 0) and prints[4] == "0:"


@pytest.mark.parametrize("shard_bytes", [24 << 20, 300])
def test_edited_texts(spark, odd_docs, no_docs, shard_bytes):
    got = rare_digest.compare_edited(odd_docs.repartition(3), shard_bytes=shard_bytes).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    assert len(got) == len(rows)
    # neighbours by doc_id; rows that share one may come in any order of their texts
    by = defaultdict(set)
    for i, t in rows:
        by[i].add(t)
    ids = sorted(by, key=lambda i: (i is not None, i or 0))
    for r in got:
        at = ids.index(r["doc_id"])
        after = by[r["doc_id"]] | by[ids[(at + 1) % len(ids)]]
        edits = {hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest() for t in by[r["doc_id"]] for u in after}
        assert r["edited_sha256"] in edits and r["n_chars"] in {len(t) for t in by[r["doc_id"]]} and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = defaultdict(set)
    for r in got:
        if len(by[r["doc_id"]]) == 1:
            prints[next(iter(by[r["doc_id"]]))].add(r["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and prints[""] == {"0:"}
    assert rare_digest.compare_edited(no_docs).count() == 0
    assert rare_digest.fingerprints(odd_docs).count() == len(rows)


@pytest.mark.parametrize("shard_bytes", [24 << 20, 900])
def test_next_documents(spark, shard_bytes):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("lorem", "ipsum", "dolor", "sit", "amet", "é")) for _ in range(rng.choice((0, 3, 60)))) for _ in range(90)]
    ids = rng.sample(range(-50, 5000), 90)
    got = {r["doc_id"]: r for r in rare_digest.compare_edited(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4), shard_bytes=shard_bytes).collect()}
    order = sorted(zip(ids, texts, strict=True))
    for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_next"] == rare_digest.likeness(got[i]["fingerprint"], got[j]["fingerprint"])
    one = rare_digest.compare_edited(spark.createDataFrame([(5, "only one")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"onlyonly").hexdigest() and one[0]["near_next"] == 1


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if _one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(((-counts[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def _misspelt(rng, n):
    bases = ["information", "presentation", "représenté", "Straßenbahn", "aaaaaaaa", "preparation", "prefabricated", "interpretation", "abababab", "ÿÿÿÿÿÿÿÿ", "preparations", "x÷×élément"]
    letters = "abeinrstéÿ"
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.choice((0, 30, 60))):
            w = rng.choice(bases)
            for _ in range(rng.choice((0, 0, 0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))
            words.append(rng.choice((w, w, w.upper())))
        rows.append((rng.choice((i, i, None)), rng.choice((" ", "-", "\n")).join(words)))
    chain = "chaining " * 3 + "chainings " * 40 + "chainingss " * 600
    return [*rows, (None, None), (3, ""), (n, "information " * 900), (n, "information " * 900), (n + 1, chain)]


@pytest.mark.parametrize("range_words", [20_000, 7, 60])
def test_variants_match_brute_force(spark, range_words):
    rows = _misspelt(random.Random(range_words), 250)
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.spelling_variants(docs, range_words=range_words).collect()
    want = _plain_variants(rows)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want) > 300
    assert any(f and r != f for f, r, *_ in want.values()) and any(v[3] > 5 for v in want.values())


def test_variants_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(odd_docs).collect()}
    assert got == _plain_variants(rows)
    assert spelling.spelling_variants(no_docs).count() == 0
