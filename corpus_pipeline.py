"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next one.

Rejected by language ID: documents without a letter, and those whose best language holds fewer than LEAST_SCORE of
their n-grams; nothing, where no labels let it learn an n-gram. Of near duplicates (five-word shingles, similarity 0.8)
the smallest id stays; documents without words have no near duplicates. Documents that share a template window with a benchmark item go. Secrets are masked in place.
The mix puts out each document once per copy, numbered in ``copy``, which replaces a column of that name.

Nulls, repeated rows and empty tables are as defined in the operators; of repeated rows one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op1_secrets, op3_jaccard, op8_mixing, op9_decontamination, op10_language
from tessera.llm._shared import fresh_path, keep_one, written

LEAST_SCORE = 0.2
SHINGLE = 5
PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op10_language.fit(docs)
    if not model.knows():
        return docs
    own = {c: f"{c}-{uuid.uuid4().hex}" for c in docs.columns if c.lower() in ("lang_pred", "score")}  # the document's own columns of these names
    known = op10_language.predict(docs.withColumnsRenamed(own), model)
    kept = known.where((F.col("lang_pred") != op10_language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Null ids come last, and texts with an equal id are told apart.
    identity = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("t"))
    found = op3_jaccard.jaccard_components(docs.select(identity.alias("doc_id"), "text"), SHINGLE, PERCENT)
    per_row = found.groupBy(F.col("doc_id").alias("row_key")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("doc_id") == F.col("component_id")).alias("keep"))
    return keep_one(docs, identity, written(per_row.where("n > 1 OR NOT keep").select("row_key", "keep"), "near-duplicates"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = op8_mixing.mixed_rows(docs).where("copies > 0")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "copy"]
    return mixed.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("mixing to target weights", mixing),
]

#: SQL can't express the n-gram filters and the forest; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = fresh_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
