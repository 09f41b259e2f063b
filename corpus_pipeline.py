"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns
of documents; the last returns token ids and digests. Nulls, empties and repeats are as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontamination, language_id, line_dedup, minhash, sentencepiece_bpe
from threadloom.llm.common import bounded, column, fresh, store, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without words or in no known language; lang becomes the language found."""
    found = language_id.identify_documents(docs, language_id.train(docs))
    changed = found.where(~F.col("accepted") | ~F.col("lang").eqNullSafe(F.col("declared")))
    rows = changed.groupBy("doc_id", "text_hash", "declared").agg(F.max("lang"), F.max("accepted"))
    i, text_hash, declared, lang, accepted = names = fresh(docs, "id", "hash", "declared", "found", "accepted")
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(text_hash)) & F.col("lang").eqNullSafe(F.col(declared))
    joined = docs.join(bounded(store(rows.toDF(*names), "changed"), 100), same, "left").where(F.coalesce(accepted, F.lit(True)))
    return joined.withColumn("lang", F.coalesce(lang, "lang")).select(*map(column, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*map(column, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, similarity 0.8."""
    return minhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(docs, keep=["doc_id", "lang", "source", "n_chars"], digests=True)


STAGES = [
    ("language-id", identify_language),
    ("line-dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", tokenize),
]

#: Similarity components and merges aren't SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
