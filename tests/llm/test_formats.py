from __future__ import annotations

import hashlib
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat_format, common, language_id, posting_lists, warc
from threadloom.llm.common import open_fs, scratch

RECORDS = [
    ({"prompt": "a<b", "completion": "c\\d"}, "prompt-completion", [("user", "a<b"), ("assistant", "c\\d")]),
    ({"instruction": "x", "input": "", "output": "z", "extra": {"prompt": 1}}, "instruction-input-output", [("user", "x"), ("assistant", "z")]),
    ({"conversations": [{"from": "human", "value": "hi", "id": 1}, {"from": "gpt", "value": None}]}, "conversations", [("user", "hi"), ("assistant", "")]),
    ({"system": "S", "messages": [{"role": "user>x\n", "content": "\\l<turn a></turn>\n\\g\\\\"}]}, "messages+system", [("system", "S"), ("user>x\n", "\\l<turn a></turn>\n\\g\\\\")]),
    ({"messages": []}, "messages-empty", []),
    ({"messages": [{"role": "assistant", "content": "é🙂\x00" * 20_000}, {"role": None, "content": "</turn>\n"}]}, "messages", [("assistant", "é🙂\x00" * 20_000), ("", "</turn>\n")]),
    ({"messages": [{"role": "system"}, {"role": "human", "content": "hi"}]}, "messages", [("system", ""), ("human", "hi")]),
    ({"turns": [{"x": 1}, {"text": "t", "role": "gpt"}, {}], "messages": None}, None, None),
    ({"turns": [{"x": {"y": [1]}}, {"text": "t", "role": "gpt"}, {}]}, "turns", [("", ""), ("gpt", "t"), ("", "")]),
    ({"messages": "no list"}, "malformed", None),
    ({"messages": None}, "malformed", None),
    ({"messages": ["hi", None, [1]]}, "malformed", None),
    ({"messages": ["hi", {"role": "user", "content": "x"}, 5, [{"role": "a"}], {"role": "assistant", "content": "y"}, None]}, "messages+malformed", [("user", "x"), ("assistant", "y")]),
    ({"system": "S", "messages": [None, {"role": "user", "content": [{"type": "text", "text": "t"}]}]}, "messages+system+malformed", [("system", "S"), ("user", '[{"type":"text","text":"t"}]')]),
    ({"system": "S", "turns": {"role": "user"}}, "malformed", None),
    ({"system": None, "question": "q", "answer": "a"}, "question-answer+system", [("system", ""), ("user", "q"), ("assistant", "a")]),
    ({"unknown": 1}, None, None),
]


def test_layouts_and_round_trip(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(90, "no json"), (91, None), (92, "[1]")]
    df = spark.createDataFrame(rows, "id int, record string").withColumn("formatted_before", F.lit(1))
    done = chat_format.format_turns(chat_format.canonical_turns(df))
    back = chat_format.read_turns(done.withColumnRenamed("turns", "before"))
    got = {r["id"]: r for r in back.collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        r = got[k]
        assert r["layout"] == layout
        if turns is None:
            assert r["formatted"] is None and r["turns"] is None
        else:
            assert [tuple(t) for t in r["turns"]] == turns == [tuple(t) for t in r["before"]]
            assert r["learned"] == [t for role, t in turns if role == "assistant" and t]
            assert sum(m["skip"] + m["take"] + m["rest"] for m in r["loss_mask"]) == len(r["formatted"])
    assert all(got[k]["layout"] is None for k in (90, 91, 92))
    nodes = done._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def test_long_texts_are_formatted_whole(spark):
    rows = [(1, 0, "user", "ab<" * 7_000_000), (1, 1, "assistant", "c" * 21_000_000), (2, 0, "user", "x"), (2, 1, "user", "y" * 21_000_000)]
    df = spark.createDataFrame(rows[:0], "conv_id long, turn long, role string, text string")
    for i, t, role, text in rows:
        df = df.unionAll(spark.range(1).select(F.lit(i).cast("long"), F.lit(t).cast("long"), F.lit(role), F.repeat(F.lit(text[:3]), len(text) // 3)))
    back = chat_format.read_turns(chat_format.format_turns(chat_format.canonical_turns(chat_format.records_of(df))))
    got = back.select("conv_id", "layout", F.transform("turns", lambda t: F.struct(t["role"], F.length(t["text"]))).alias("t"), F.length(F.array_join("learned", "")).alias("n")).collect()
    assert sorted((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got) == [
        (1, "prompt-response", [("user", 21_000_000), ("assistant", 21_000_000)], 21_000_000),
        (2, "messages", [("user", 0), ("user", 21_000_000)], 0),
    ]


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    got = chat_format.canonical_turns(chat_format.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    by = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got.collect()}
    assert by == {1: [("", ""), ("user", "a"), ("user", "b")], None: [("assistant", "x")], 2: [("user", "a"), ("user", "a")]}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_turns(chat_format.canonical_turns(chat_format.records_of(empty))).count() == 0


def test_warc_round_trip(spark):
    body = "é" * 600
    rows = [(1, "http://a/\n x", body), (1, "http://a", body), (2, None, body), (None, "u", body), (3, "u", None), (4, "u", ""), (5, "v", "x" * 2_000_000), (6, "v", "y" * 999), (7, "v", "y" * 999), (8, "w", "z" * 1000), (8, "w", "z" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))
    for shard_bytes, roll in ((64 << 20, 32 << 20), (1500, 300)):
        out = scratch(spark, "warc")
        manifest = warc.write_warc(pages, out, shard_bytes=shard_bytes, roll_bytes=roll)
        assert manifest.agg(F.sum("records")).first()[0] == len(rows)
        got = warc.read_warc(spark, out).collect()
        assert {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got} == {(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
        kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["page_id"] in (None, 1, 2, 6, 7, 8))
        assert kinds == sorted([(0, "revisit", 2), (1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (8, "revisit", 8)], key=lambda k: (k[0], k[1]))
        assert all(r["payload"].decode() in {h or "" for _, _, h in rows} for r in got if r["record_type"] == "response")
    out = scratch(spark, "warc")
    warc.write_warc(pages.limit(0), out)
    assert warc.read_warc(spark, out).count() == 0


def test_warc_files_are_deterministic(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"page {k} " * 200) for k in range(100)], "page_id long, url string, html string")
    seen = []
    for parts in (1, 5):
        out = scratch(spark, "warc")
        names = {}
        for r in warc.write_warc(pages.repartition(parts), out, shard_bytes=40_000, roll_bytes=3000).collect():
            fs, local = open_fs(r["path"])
            with fs.open_input_stream(local, compression=None) as f:
                names[r["path"].rpartition("/")[2]] = hashlib.sha256(f.read()).hexdigest()
        seen.append(names)
    assert seen[0] == seen[1] and len(seen[0]) > 3


@pytest.mark.parametrize("ids", [[7] * 60, [None] * 60, [*range(30), *range(1 << 62, (1 << 62) + 30)], [-(1 << 63), (1 << 63) - 1, 0, None], [k * k for k in range(200)]])
def test_warc_shards_hold_about_the_same_bytes(spark, ids):
    pages = spark.createDataFrame([(i, None, f"{k:04d}" * 250) for k, i in enumerate(ids)], "page_id long, url string, html string")
    out = scratch(spark, "warc")
    got = warc.write_warc(pages.repartition(3), out, shard_bytes=5000).groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert sum(r["n"] for r in got) == len(ids) and all(r["n"] <= 20 for r in got)
    assert sorted(r["page_id"] or 0 for r in warc.read_warc(spark, out).collect()) == sorted(i or 0 for i in ids)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    words = {"en": "the and of this with that from", "de": "der die und das nicht mit von", "fr": "le la les dans est pour avec"}
    rows = [(k, " ".join(np.random.default_rng(k).choice(w.split(), 30)), lang, f"h{k % 3}.{lang}", 0) for k, (lang, w) in enumerate((x for _ in range(40) for x in words.items()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.identify_documents(docs, model).collect()}
    assert all(got[i]["lang"] == lang and got[i]["accepted"] for i, _, lang, _, _ in rows)
    odd = language_id.identify_documents(odd_docs, model).collect()
    assert len(odd) == 14
    assert all(not r["accepted"] and r["lang"] == "und" for r in odd if r["doc_id"] in (4, 5, 6))
    assert all(r["lang"] == "en" and r["accepted"] for r in odd if r["doc_id"] in (1, 2, 3))
    assert language_id.identify_documents(no_docs, model).count() == 0
    assert language_id.identify_documents(odd_docs, language_id.train(no_docs)).where("accepted").count() == 0


def test_posteriors_match_the_plain_formula(spark):
    """Votes counted and fused row by row in plain Python."""
    rng = np.random.default_rng(6)
    words = {"en": "the and of this with that from".split(), "de": "der die und das nicht mit von".split()}
    rows = []
    for k in range(80):
        lang = ["en", "de"][k % 2]
        text = None if k % 19 == 0 else " ".join(rng.choice(words[lang], rng.integers(0, 4)))
        rows.append((k, text, [lang, None, "en"][k % 3], [f"a{k % 5}.{lang}", None, "plain", "x.de"][k % 4]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.train(docs)
    langs, n = model.langs, len(model.langs)
    ll = [model.likelihoods((t or "").encode()) / 3 for _, t, _, _ in rows]
    base = [1e-3 if x == "und" else (1 - 1e-3) / (n - 1) for x in langs]
    soft = lambda x: [v / sum(e) for e in [[math.exp(y - max(x)) for y in x]] for v in e]
    own = [soft([a + math.log(b) for a, b in zip(x, base, strict=True)]) if any(x) else [1 / n] * n for x in ll]
    suffix = lambda h: h.rpartition(".")[2] if h and "." in h else ""

    def prior(k, same, parent):
        rest = [sum(own[j][i] for j in range(len(rows)) if j != k and same(rows[j])) for i in range(n)]
        return [(r + 20 * p) / (sum(rest) + 20) for r, p in zip(rest, parent, strict=True)]

    got = {r["doc_id"]: r for r in language_id.identify_documents(docs.repartition(3), model).collect()}
    for k, (i, _, declared, host) in enumerate(rows):
        p0 = prior(k, lambda r: True, base)
        p1 = prior(k, lambda r: suffix(r[3]) == suffix(host), p0)  # noqa: B023
        p2 = prior(k, lambda r: (r[3] or "") == (host or ""), p1)  # noqa: B023
        p3 = prior(k, lambda r: (r[2] or "") == (declared or ""), p0)  # noqa: B023
        post = soft([a + math.log(b) + math.log(c) - math.log(d) for a, b, c, d in zip(ll[k], p2, p3, p0, strict=True)])
        best = max(range(n), key=post.__getitem__)
        if any(ll[k]):
            assert got[i]["lang"] == langs[best] and abs(got[i]["posterior"] - post[best]) < 1e-5
            assert got[i]["accepted"] == (langs[best] != "und" and post[best] >= 0.5)
        else:
            assert (got[i]["lang"], got[i]["posterior"], got[i]["accepted"]) == ("und", 0.0, False)


def test_markup_is_taken_out_in_one_pass():
    page = b"<p>a &amp; b<script>x<y</SCRIPT ><!-- <b> -->c<style>d</style> <i>e"
    assert b" ".join(language_id.plain(page).split()) == b"a & b c e"
    assert language_id.plain(b"a < b") == b"a < b" and language_id.plain(b"<script>x") == b" x" and language_id.plain(b"") == b""
    began = time.perf_counter()
    for part in (b"<", b"<script ", b"<!--", b"<style>", b"</script"):
        language_id.plain(part * 500_000)
    assert time.perf_counter() - began < 30


def test_evidence_decides_short_pages(spark):
    lang = {"en": "the and of this with that from", "de": "der die und das nicht mit von"}
    docs = spark.createDataFrame([(w, k) for k, v in lang.items() for w in [v] * 20], "text string, lang string")
    page = lambda k, text: f'<html lang="{k}"><head><script>var x = "the and of"</script></head><body>{text}</body></html>'
    rows = [(n, f"https://host{n % 4}.de/x", page("de", lang["de"])) for n in range(60)] + [(n, f"https://host{n % 4}.com/x", page("en", lang["en"])) for n in range(60, 120)]
    rows += [(200, "https://host1.de/y", page("de", "in")), (201, "https://host1.com/y", page("en", "in")), (202, None, None), (203, "no url", ""), (204, "https://host1.de/z", page("de", lang["en"] * 3))]
    got = {r["page_id"]: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), language_id.train(docs)).collect()}
    assert got[200]["lang"] == "de" and got[201]["lang"] == "en"  # two letters: the host and the markup decide
    assert got[204]["lang"] == "en"  # a long text outweighs both
    assert not got[202]["accepted"] and not got[203]["accepted"]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 8)) * 4
    x = np.concatenate([centers[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 8)), np.zeros((1, 8)) + 1.5]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(10_000 + k, x[5].tolist()) for k in range(500)] + [(20_000, None), (20_001, [0.0] * 8), (20_002, [float("nan")] * 8), (20_003, [None] + [1.0] * 7), (20_004, [1.0] * 7), (None, x[3].tolist()), (7, x[7].tolist()), (20_100, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))
    got: dict[int, list] = {}
    for r in posting_lists.search(df, df.where("vec_id % 100 = 0"), list_length=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    ids = np.concatenate([np.arange(len(x)), 10_000 + np.arange(500)])
    full = np.concatenate([x, np.repeat(x[5:6], 500, axis=0)]).astype(np.float64)
    hit = 0
    for q, rank in got.items():
        d = np.sqrt(((full - full[ids == q][0]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hit += len({int(ids[k]) for k in order} & {i for _, i in rank})
        assert rank == sorted(rank) and len(rank) == 10 and all(abs(s - d[ids == i][0]) < 1e-12 for s, i in rank)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and hit >= 0.9 * 10 * len(got)
    assert [i for _, i in got[10_000]] == [5, *range(10_001, 10_010)]
    few = df.where("vec_id < 4")
    assert [r["rank"] for r in posting_lists.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2, 3]
    assert posting_lists.search(df.limit(0), df.limit(0)).count() == 0
    assert posting_lists.search(df.where("vec_id >= 20000"), df.where("vec_id = 20001")).count() == 0


def test_lists_read_grow_with_the_lists(spark):
    """Isotropic vectors: the distance ratio prunes little, so the number of lists read decides."""
    x = np.random.default_rng(3).normal(size=(20_000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got: dict[int, set] = {}
    for r in posting_lists.search(df, df.where("vec_id % 200 = 0"), list_length=50, probes=4).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    near = lambda q: set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11].tolist())
    assert len(got) == 100 and sum(len(near(q) & ids) for q, ids in got.items()) >= 0.9 * 10 * len(got)


def test_outliers_and_small_groups_get_all_their_neighbours(spark):
    """A far vector and a tight group of 3 that have lists of their own, and an id of many vectors beside a query."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(2000, 8)), [[90.0] + [0.0] * 7], [[0.0, 70.0] + [0.0] * 6] * 3 + rng.normal(size=(3, 8)) * 1e-3, [[0.0, 0.0, 500.0] + [0.0] * 5] * 900 + rng.normal(size=(900, 8))])
    ids = np.concatenate([np.arange(2004), [3000], np.full(899, 3001)])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got: dict[int, list] = {}
    for r in posting_lists.search(df, df.where("vec_id in (2000, 2001, 2002, 2003, 3000)"), list_length=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(got) == [2000, 2001, 2002, 2003, 3000]
    for q, rank in got.items():
        score: dict[int, float] = {}
        for i, d in zip(ids.tolist(), np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1)).tolist()):
            score[i] = min(d, score.get(i, d))
        near = [i for _, i in sorted((d, i) for i, d in score.items() if i != q)][:10]
        assert len(rank) == len(set(rank)) == 10 and len(set(near) & set(rank)) >= 9


@pytest.mark.parametrize("n", [1, 5, 400])
def test_graph_finds_near_centroids(n):
    rng = np.random.default_rng(n)
    c, x = rng.normal(size=(n, 16)), rng.normal(size=(50, 16))
    found, d = posting_lists.Graph(c).search(x, 8)
    exact = np.argmin(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)
    assert (found[:, 0] == exact).mean() >= 0.95 and (np.diff(d, axis=1) >= 0).all()


def test_hot_payloads_are_dealt_to_several_tasks(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "http://h", "a page not found " * 80 if k % 3 else f"page {k} " * 200) for k in range(90)], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "hot_join", lambda a, b, key, count, _: common.hot_join(a, b, key, count, 1 << 30, least=7))
    out = scratch(spark, "warc")
    warc.write_warc(pages, out)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, out).collect()}
    assert got == {k: ("revisit", 89) if k % 3 and k != 89 else ("response", None) for k in range(90)}


def test_copies_of_a_text_train_a_model_once(spark):
    rows = [("en", "the cat sat on the mat")] * 200 + [("de", "der Hund lief in den Wald"), ("de", "the cat sat on the mat"), (None, "x"), ("en", None)]
    a = language_id.train(spark.createDataFrame(rows, "lang string, text string").repartition(7), sample=1000)
    b = language_id.train(spark.createDataFrame(rows[199:][::-1], "lang string, text string").coalesce(1), sample=1000)
    assert a.langs == b.langs and (a.logp == b.logp).all()
