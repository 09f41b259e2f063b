"""Language identification by Bayesian fusion of evidence.

Four sources: the text's likelihood in each language (byte trigrams), the language that the markup declares, the
suffix of the address, and the host. What a declared language, suffix or host says about languages is
counted over all rows by grouped aggregation of the rows' own text posteriors. Hosts are smoothed
towards their suffix and suffixes towards the whole table; a row's own vote is taken out of what it
is judged by. A background model, uniform over trigram buckets, stands for text in no known language.

The trigram model is trained on a bounded sample: at most about `sample` labelled documents.
"""

from __future__ import annotations

import functools
import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import column, fields, hot_join, lean, store, table

BUCKETS = 1 << 15
NONE = "und"
#: Neighbouring trigrams aren't independent: their log-likelihoods count for a third.
TEMPER = 1 / 3
_FOLD = np.arange(256, dtype=np.uint32)
for _b in range(128):
    _FOLD[_b] = ord(chr(_b).lower()) if chr(_b).isalpha() else 32
_OPENS = re.compile(rb"<(?:(!--)|(script|style)\b)?", re.I)
_ENDS = {b"!--": re.compile(rb"-->"), b"script": re.compile(rb"</script\s*>", re.I), b"style": re.compile(rb"</style\s*>", re.I), b"": re.compile(rb">")}
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the text's byte trigrams: ASCII letters in lower case, runs of other ASCII as one space."""
    x = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = x == 32
    x = x[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(x) < 3:
        return np.empty(0, np.uint32)
    return ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(17)


def plain(page: bytes) -> bytes:
    """The text of a page: without tags, comments, scripts and styles. One pass, as what isn't closed is looked for once."""
    out, at, missing = [], 0, set()
    while True:
        m = _OPENS.search(page, at)
        if m is None:
            break
        out.append(page[at : m.start()])
        end = None
        for kind in ((m[1] or m[2] or b"").lower(), b""):
            if kind not in missing and end is None:
                end = _ENDS[kind].search(page, m.end())
                if end is None:
                    missing.add(kind)
        if end is None:
            out.append(b"<")
            at = m.start() + 1
        else:
            out.append(b" ")
            at = end.end()
    out.append(page[at:])
    text = b"".join(out)
    return html.unescape(text.decode(errors="replace")).encode(errors="replace") if b"&" in text else text


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            counts[lang] += np.bincount(trigrams(x.as_py() or b""), minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(counts.keys(), pa.string()), "n": pa.array([c.tobytes() for c in counts.values()], pa.binary())})


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = [*sorted(counts), NONE]
        smooth = [c + 0.05 for _, c in sorted(counts.items())]
        self.logp = np.array([np.log(c / c.sum()) for c in smooth] + [np.full(BUCKETS, -math.log(BUCKETS))]).astype(np.float32)

    def likelihoods(self, text: bytes) -> np.ndarray:
        t = trigrams(text)
        if len(t) > 4 * BUCKETS:
            return self.logp.astype(np.float64) @ np.bincount(t, minlength=BUCKETS)
        return self.logp[:, t].sum(axis=1, dtype=np.float64)


def train(labelled: DataFrame, sample: int = 4000) -> Model:
    """From labelled texts (lang, text), of which about `sample` are taken by a hash of the text; copies of a text count once.

    The same rows are taken whatever their order is. Rows with a null lang or text take no part; without any other row the model knows the background only.
    """
    known = labelled.where("lang is not null and text is not null")
    step = max(1, known.count() // sample)
    taken = known.select(F.xxhash64("text").alias("h"), "lang", F.col("text").cast("binary").alias("text")).where(F.pmod("h", F.lit(step)) == 0)
    rows = taken.groupBy("h").agg(F.min(F.struct("lang", "text")).alias("x")).orderBy("h").limit(2 * sample).select("x.lang", "x.text")
    counts: dict[str, np.ndarray] = {}
    for lang, n in rows.coalesce(4).mapInArrow(_count, "lang string, n binary").collect():
        counts[lang] = counts.get(lang, 0) + np.frombuffer(n, np.int64)
    return Model(counts)


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _prior(langs: list[str], none_prior: float) -> np.ndarray:
    return np.array([none_prior if x == NONE else (1 - none_prior) / max(1, len(langs) - 1) for x in langs])


def _score(shared, markup: bool, none_prior: float, names: list[str], batches):
    """Adds each text's tempered log-likelihoods and its own posterior, which is its vote, in the place of the text, which comes last.

    A text without trigrams votes for all languages alike.
    """
    model = shared.value
    prior = np.log(_prior(model.langs, none_prior))
    for batch in batches:
        scores = np.zeros((batch.num_rows, len(model.langs)))
        for k, x in enumerate(batch.columns[-1]):
            text = x.as_py() or b""
            scores[k] = model.likelihoods(plain(text) if markup else text) * TEMPER
        own = _softmax(scores + prior)
        own[~scores.any(axis=1)] = 1 / len(model.langs)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(x), pa.list_(pa.float64())) for x in (scores, own))], names=names)


def fuse(ll: np.ndarray, own: np.ndarray, host: np.ndarray, suffix: np.ndarray, declared: np.ndarray, total: np.ndarray, langs: list[str], none_prior: float, weight: float) -> np.ndarray:
    """Posteriors (rows x languages) from log-likelihoods and the votes of each row's host, suffix, declared language and of all rows."""

    def smoothed(counts, parent):
        rest = np.maximum(counts - own, 0)
        return (rest + weight * parent) / (rest.sum(axis=1, keepdims=True) + weight)

    p0 = smoothed(total[None, :], _prior(langs, none_prior))
    p2 = smoothed(host, smoothed(suffix, p0))
    return _softmax(ll + np.log(p2) + np.log(smoothed(declared, p0)) - np.log(p0))


def _fuse(langs: list[str], total: list[float], none_prior: float, weight: float, at_least: float, n_keys: int, names: list[str], batches):
    """lang, posterior and accepted, after the key columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ll, own, host, suffix, declared = (np.array(c.to_pylist()) for c in batch.columns[n_keys:])
        post = fuse(ll, own, host, suffix, declared, np.array(total), langs, none_prior, weight)
        best, empty = post.argmax(axis=1), ~ll.any(axis=1)
        posterior = np.where(empty, 0.0, np.round(post.max(axis=1), 6))
        lang = [NONE if e else langs[k] for k, e in zip(best.tolist(), empty.tolist(), strict=True)]
        accepted = [x != NONE and p >= at_least for x, p in zip(lang, posterior.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], pa.array(lang, pa.string()), pa.array(posterior), pa.array(accepted, pa.bool_())], names=names)


def identify(rows: DataFrame, model: Model, markup: bool, none_prior: float = 1e-3, weight: float = 20.0, at_least: float = 0.5) -> DataFrame:
    """Adds lang, posterior and accepted to rows (text, declared, host, and any keys) and takes text away.

    A row is accepted if its text has a trigram of letters and its best language isn't the background and
    has a posterior of `at_least`. Nulls and empties: a null text counts as empty and isn't accepted (its
    lang is 'und', its posterior 0); a null declared language, host or suffix is a value like any other,
    so that it says what rows without one are like. Repeated rows each count; an empty table gives none. Keys keep
    their columns, whatever their names; those named lang, posterior or accepted give way.
    """
    spark = rows.sparkSession
    langs, n = model.langs, len(model.langs)
    shared = spark.sparkContext.broadcast(model)
    new = ["lang", "posterior", "accepted"]
    keys = [c for c in rows.columns if c not in ("text", *new)]
    inner = [f"key{k}" for k in range(len(keys))]  # so that no name of theirs clashes with one used here
    named = rows.select(*[column(c).alias(k) for c, k in zip(keys, inner, strict=True)], F.coalesce("declared", F.lit("")).alias("declared"), F.coalesce("host", F.lit("")).alias("host"), F.col("text").cast("binary").alias("text"))
    schema = fields(named, [*inner, "declared", "host"], ll="array<double>", own="array<double>")
    scored = named.mapInArrow(functools.partial(lean, _score, shared, markup, none_prior, schema.names), schema)
    scored = store(scored.withColumn("suffix", F.lower(F.regexp_extract("host", r"\.([A-Za-z]+)$", 1))), "likelihoods")

    def sums(votes: str) -> Column:
        return F.array(*[F.sum(F.col(votes)[k]) for k in range(n)])

    counted = lambda by, df, votes, k: df.groupBy(by).agg(sums(votes).alias(f"n_{by}"), k.alias(f"rows_{by}"))
    # a host has one suffix, so suffixes are summed up from hosts, and the total from suffixes
    hosts = store(scored.groupBy("host").agg(F.first("suffix").alias("suffix"), sums("own").alias("n_host"), F.count(F.lit(1)).alias("rows_host")), "hosts")
    suffixes = store(counted("suffix", hosts, "n_host", F.sum("rows_host")), "suffixes")
    declared = store(counted("declared", scored, "own", F.count(F.lit(1))), "declared")
    total = [float(x or 0) for x in suffixes.agg(sums("n_suffix")).first()[0]]  # a number a language
    row_bytes = 16 * n + 100
    joined = hot_join(scored.drop("suffix"), hosts, "host", "rows_host", row_bytes)
    joined = hot_join(joined, suffixes, "suffix", "rows_suffix", row_bytes)
    joined = hot_join(joined, declared, "declared", "rows_declared", row_bytes)
    needed = joined.select(*inner, "ll", "own", "n_host", "n_suffix", "n_declared")
    out = fields(named, inner, lang="string", posterior="double", accepted="boolean")
    done = needed.mapInArrow(functools.partial(lean, _fuse, langs, total, none_prior, weight, at_least, len(inner), out.names), out)
    return done.select(*[F.col(k).alias(c) for c, k in zip(keys, inner, strict=True)], *new)


def host_of(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def declared_of(page: str | Column) -> Column:
    return F.lower(F.regexp_extract(page, _DECLARED, 1))


def identify_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Of documents (doc_id, text, lang, source): lang is what they declare, source is their host. Nulls and so on as for identify()."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("lang").alias("declared"), F.col("source").alias("host"), "text")
    return identify(rows, model, markup=False)


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """Of pages (page_id, url, html); a null or odd url has no host, a null html no text. Nulls and so on as for identify()."""
    rows = pages.select("page_id", declared_of("html").alias("declared"), host_of("url").alias("host"), F.col("html").alias("text"))
    return identify(rows, model, markup=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each page: doc_id or page_id, lang, posterior, accepted."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    a = identify_documents(docs, model).select("doc_id", F.lit(None).cast("long").alias("page_id"), "lang", "posterior", "accepted")
    b = identify_pages(table(spark, sf_dir, "pages"), model).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "lang", "posterior", "accepted")
    return a.unionAll(b)
