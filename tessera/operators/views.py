"""Listings over catalog tables. Counts are made before joining, so a join never multiplies rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_listing(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``documents`` (id) with chunk_count and vector_count (chunks with a vector in any profile), ordered by file_name."""
    has = vectors.select("chunk_id").distinct().withColumn("_v", F.lit(1))
    per_document = chunks.select("document_id", F.col("id").alias("chunk_id")).join(has, "chunk_id", "left").groupBy("document_id").agg(
        F.count_distinct("chunk_id").alias("chunk_count"), F.count_distinct(F.when(F.col("_v") == 1, F.col("chunk_id"))).alias("vector_count")
    )
    rows = documents.join(per_document.withColumnRenamed("document_id", "id"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.withColumns({"chunk_count": zero("chunk_count"), "vector_count": zero("vector_count")}).orderBy("file_name", "id")


def profile_listing(profiles: DataFrame, states: DataFrame, vectors: DataFrame, kb_id: str | None = None) -> DataFrame:
    """``profiles`` with status (EMPTY if there is none) and vector_count; of one knowledge base, or of all."""
    own = profiles if kb_id is None else profiles.where(F.col("knowledge_base_id") == kb_id)
    counts = vectors.groupBy(F.col("embedding_profile_id").alias("id")).agg(F.count("chunk_id").alias("vector_count"))
    state = states.select("knowledge_base_id", F.col("embedding_profile_id").alias("id"), "status")
    rows = own.join(state, ["knowledge_base_id", "id"], "left").join(counts, "id", "left")
    return rows.withColumns({"status": F.coalesce("status", F.lit("EMPTY")), "vector_count": F.coalesce("vector_count", F.lit(0))})


def searchable_chunks(chunks: DataFrame, documents: DataFrame, vectors: DataFrame, profile: str | None = None) -> DataFrame:
    """The chunks that a search ranks: those of active documents that have a vector, in ``profile`` or in any."""
    active = documents.where("status = 'active'").select(F.col("id").alias("document_id"))
    own = vectors if profile is None else vectors.where(F.col("embedding_profile_id") == profile)
    return chunks.join(active, "document_id", "left_semi").join(own.select(F.col("chunk_id").alias("id")), "id", "left_semi")


def chunk_listing(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunks with their documents' file names, in the order of these and of the chunks."""
    own = chunks.join(documents.select(F.col("id").alias("document_id"), "file_name"), "document_id")
    return own.select("id", "document_id", "file_name", "chunk_index", "text").orderBy("file_name", "document_id", "chunk_index")


def dashboard(knowledge_bases: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, states: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: four counts, whether vectors come from a neural model, and the latest index status."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    latest = states.agg(F.coalesce(F.max_by("status", F.struct("updated_at", "embedding_profile_id")), F.lit("EMPTY")).alias("index_status"))
    neural = profiles.agg(F.when(F.count_if(F.col("runtime") == "python-sentence-transformers") > 0, "READY").otherwise("MOCK_ONLY").alias("embedding_status"))
    out = n(knowledge_bases, "knowledge_bases")
    for part in (n(documents, "documents"), n(chunks, "chunks"), n(vectors, "vectors"), neural, latest):
        out = out.crossJoin(part)  # single rows
    return out


def service_documents(documents: DataFrame) -> DataFrame:
    """The active documents, latest first, each with the total of them."""
    own = documents.where(F.col("status") == "active")
    total = own.agg(F.count(F.lit(1)).alias("total"))
    return own.crossJoin(F.broadcast(total)).orderBy(F.desc("created_at"), "id")  # one row


def service_statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: active documents, all chunks (those without a document too), chunks with a vector."""
    a = documents.agg(F.count_if(F.col("status") == "active").alias("active_documents"))
    b = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("vector").isNotNull()).alias("vectors"))
    return a.crossJoin(b)


def diagnostics(knowledge_bases: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, profiles: DataFrame, states: DataFrame) -> dict[str, DataFrame]:
    """What a catalog holds, by name: its knowledge bases, documents, counts by document and profile, and profile states."""
    own = states.select(F.col("embedding_profile_id").alias("id"), "status")
    return {
        "knowledge_bases": knowledge_bases.select("id", "name", "root_path"),
        "documents": documents.select("file_name", "status", "file_hash"),
        "chunks": chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count")),
        "vectors": vectors.groupBy("embedding_profile_id").agg(F.count(F.lit(1)).alias("vector_count")),
        "profiles": profiles.select("id", "model_id", "dimension", "config_hash").join(own, "id", "left").drop("id"),
    }


def register_views(spark: SparkSession, **tables: DataFrame) -> None:
    """Temporary views, for statements in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
