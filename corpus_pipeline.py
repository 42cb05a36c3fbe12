"""The training-data pipeline: quality, near-duplicates, personal data, mixing and packing, each stage on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import kneser_ney, mixing, ngram_join, surrogate, two_fit_pack
from wardlight.llm.common import materialize, scratch, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _same_row(docs: DataFrame, rows: DataFrame, key: Column) -> DataFrame:
    """Rows of docs whose id and text stand in rows, (_id, _key); nulls match nulls."""
    return docs.join(small(rows, rows.count()), F.col("doc_id").eqNullSafe(F.col("_id")) & key.eqNullSafe(F.col("_key")), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier keeps; a null doc_id is judged by its text like any other, repeated rows are kept or dropped alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with scratch():
        judged = kneser_ney.classify(docs, labels)
        kept = materialize(judged.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), outer=True)
    return _same_row(docs, kept, F.xxhash64("text")).select(*COLUMNS)


def ngram_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more; rows without a doc_id link with nothing and all stay. An id with two texts is two documents, one row of repeated ones stays."""
    with scratch():
        named = F.col("doc_id").isNotNull()
        joined = ngram_join.join(docs.where(named)).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        kept = materialize(joined, outer=True)
    key = ngram_join.text_hash("text")
    single = _same_row(docs.where(named), kept.where("_n = 1").drop("_n"), key).select(*COLUMNS)
    repeated = _same_row(docs.where(named), kept.where("_n > 1").drop("_n"), key).select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated).unionByName(docs.where(~named).select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    replaced = surrogate.replace_entities(docs.select(*COLUMNS), key=surrogate.session_key(spark), count_col=None)
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; sources with small shares are repeated towards the target entropy, at most twice."""
    counted = docs.select(*COLUMNS, mixing.word_count().alias("n_words"))
    return mixing.mix(counted, "n_words", budget=None, entropy_share=0.97, max_repeats=2.0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the drawn documents in sequences of 2048 tokens."""
    return two_fit_pack.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_dedup),
    ("PII surrogates", personal_data),
    ("source mixing", source_mixing),
    ("best-fit packing", packing),
]
#: SQL can't express the stages' models, sketches, keyed digests and packing; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's rows are written and read again, and a stage's own tables are removed once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = materialize(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
