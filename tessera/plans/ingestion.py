"""Registered queries over files and the catalog: folders written from documents, scanned, synced with changes, indexed.

A file holds the documents of 64 consecutive ids, a line feed after each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import TRIM
from tessera.operators.catalog import Catalog
from tessera.operators.embedding import HashedNgramProvider
from tessera.sources.files import scan
from tessera.sources.tables import fresh_path

IDS, SIZE, OVERLAP = 64, 400, 40
BROKEN = "folder % 5 = 3"


def _folder(spark: SparkSession, sf_dir: str, where: str = "true", changed: str = "false", broken: str = "false") -> str:
    """A folder of text files of the folders that are wanted; the lines of some are changed, or end in a byte that isn't UTF-8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr(f"doc_id DIV {IDS}").alias("folder"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    end = F.when(F.expr(broken), F.unhex(F.lit("FF")).cast("string")).when(F.expr(changed), F.lit(" changed")).otherwise(F.lit(""))
    lines = docs.where(where).select("folder", "doc_id", F.concat("text", end).alias("value"))
    path = fresh_path(spark, "folder")
    writer = lines.repartition("folder").sortWithinPartitions("folder", "doc_id").select("value", "folder").write.partitionBy("folder")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)  # tasks move the many files, not the driver
    return path


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files and errors of a folder, by paths that stay the same when it is written anew."""
    named = F.concat(F.lit("/kb/"), F.regexp_extract("file_path", r"/folder=(\d+)/", 1), F.lit(".txt"))
    good, bad = scan(spark, path)
    return good.withColumn("file_path", named), bad.withColumn("file_path", named)


def folder_scan(spark, sf_dir):
    """Path, type, hash and length of the text files; errors of the others."""
    good, bad = _files(spark, _folder(spark, sf_dir, broken=BROKEN))
    own = good.select("file_path", "file_type", "file_hash", F.length("text").alias("n_chars"), F.lit(False).alias("failed"))
    return own.unionByName(bad.select("file_path", F.lit(True).alias("failed")), allowMissingColumns=True)


FIRST, SECOND, CHANGED = "folder % 9 <> 4", "folder % 7 <> 2", "folder % 4 = 1"


def catalog_sync(spark, sf_dir):
    """What three scans of a folder change in a catalog: new; changed, with files gone, added and broken; as before."""
    catalog = Catalog(spark, fresh_path(spark, "catalog"), buckets=16)
    kb = catalog.create("kb", "/kb", SIZE, OVERLAP)
    then = _files(spark, _folder(spark, sf_dir, SECOND, CHANGED, BROKEN))
    rows = []
    for step, files in enumerate((_files(spark, _folder(spark, sf_dir, FIRST)), then, then), 1):
        done = catalog.sync(kb, *files)
        stored = catalog.table("document").count(), catalog.table("chunk").count()
        rows.append((step, *(done[c] for c in ("added", "updated", "unchanged", "removed", "chunks_created")), len(done["errors"]), *stored))
    return spark.createDataFrame(rows, "step int, added long, updated long, unchanged long, removed long, chunks_created long, errors long, documents long, chunks long")


def catalog_index(spark, sf_dir):
    """States of documents, profiles and vectors after indexing, a change, a second profile, and deletes."""
    catalog = Catalog(spark, fresh_path(spark, "catalog"), buckets=16)
    kb = catalog.create("kb", "/kb", SIZE, OVERLAP)
    catalog.sync(kb, *_files(spark, _folder(spark, sf_dir)))
    rows = []

    def note(step: str) -> None:
        documents, states = catalog.table("document"), catalog.table("index_state")
        n = {s: documents.where(F.col("status") == s).count() for s in ("INDEXED", "WAITING_EMBEDDING")}
        rows.append((step, n["INDEXED"], n["WAITING_EMBEDDING"], catalog.table("vector_record").count(), states.where("status = 'INDEXED'").count(), states.where("status = 'STALE'").count()))

    first = catalog.index(kb, HashedNgramProvider(8))
    note("index")
    catalog.sync(kb, *_files(spark, _folder(spark, sf_dir, changed=CHANGED)))
    note("change")
    catalog.index(kb, HashedNgramProvider(4))
    note("second profile")
    catalog.delete_vectors(profile_id=first["profile_id"])
    note("delete a profile's vectors")
    catalog.delete_document(catalog.table("document").where("file_path = '/kb/0.txt'").first().id)
    note("delete a document")
    return spark.createDataFrame(rows, "step string, indexed long, waiting long, vectors long, active_profiles long, stale_profiles long")


_FILES = f"""
lines AS (SELECT doc_id // {IDS} AS folder, doc_id, coalesce(text, '') AS text FROM documents),
files AS (
  SELECT folder, string_agg(text || chr(10), '' ORDER BY doc_id) AS text, string_agg(text || CASE WHEN {CHANGED} THEN ' changed' ELSE '' END || chr(10), '' ORDER BY doc_id) AS text2
  FROM lines GROUP BY folder
)"""


def _chunks(text: str) -> str:
    step = SIZE - OVERLAP
    return f"""(
  SELECT folder, count(*) AS n FROM files, unnest(range(0, greatest(0, CAST(ceil((length({text}) - {SIZE}) / {step}.0) AS BIGINT)) + 1)) t(i)
  WHERE regexp_replace(substr({text}, CAST(i * {step} + 1 AS BIGINT), {SIZE}), '{TRIM}', '', 'g') <> '' GROUP BY folder)"""


_SIZES = f"""{_FILES}, sizes AS (
  SELECT folder, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2, {FIRST} AS was, {SECOND} AS there, {BROKEN} AS broken, {CHANGED} AS changed
  FROM files LEFT JOIN {_chunks("text")} a USING (folder) LEFT JOIN {_chunks("text2")} b USING (folder)
)"""
_SYNC_SQL = f"""WITH {_SIZES}, sums AS (
  SELECT count_if(was) AS first_added, CAST(coalesce(sum(n1) FILTER (was), 0) AS BIGINT) AS first_chunks,
    count_if(there AND NOT broken AND NOT was) AS added, count_if(there AND NOT broken AND was AND changed) AS updated, count_if(there AND NOT broken AND was AND NOT changed) AS unchanged,
    count_if(was AND NOT there) AS removed, count_if(there AND broken) AS errors,
    CAST(coalesce(sum(n2) FILTER (there AND NOT broken AND (NOT was OR changed)), 0) AS BIGINT) AS made,
    CAST(coalesce(sum(CASE WHEN there AND NOT broken THEN n2 WHEN there AND was THEN n1 END), 0) AS BIGINT) AS stored_chunks,
    count_if(there AND (was OR NOT broken)) AS stored, count_if(there AND NOT broken) AS good
  FROM sizes
)
SELECT 1 AS step, first_added AS added, 0 AS updated, 0 AS unchanged, 0 AS removed, first_chunks AS chunks_created, 0 AS errors, first_added AS documents, first_chunks AS chunks FROM sums
UNION ALL SELECT 2, added, updated, unchanged, removed, made, errors, stored, stored_chunks FROM sums
UNION ALL SELECT 3, 0, 0, good, 0, 0, errors, stored, stored_chunks FROM sums
"""
_INDEX_SQL = f"""WITH {_SIZES}, sums AS (
  SELECT count(*) AS docs, count_if(n1 > 0) AS full1, count_if(n2 > 0) AS full2, count_if(changed) AS touched, count_if(n1 > 0 AND NOT changed) AS kept, CAST(sum(n1) AS BIGINT) AS chunks1,
    CAST(sum(n2) AS BIGINT) AS chunks2, CAST(coalesce(sum(n1) FILTER (NOT changed), 0) AS BIGINT) AS left1, CAST(coalesce(max(n2) FILTER (folder = 0), 0) AS BIGINT) AS own FROM sizes
)
SELECT 'index' AS step, full1 AS indexed, docs - full1 AS waiting, chunks1 AS vectors, 1 AS active_profiles, 0 AS stale_profiles FROM sums
UNION ALL SELECT 'change', kept, docs - kept, left1, 0, 1 FROM sums
UNION ALL SELECT 'second profile', full2, docs - full2, left1 + chunks2, 1, 1 FROM sums
UNION ALL SELECT 'delete a profile''s vectors', full2, docs - full2, chunks2, 1, 1 FROM sums
UNION ALL SELECT 'delete a document', full2 - 1, docs - full2, chunks2 - own, 1, 1 FROM sums
"""
_SCAN_SQL = f"""WITH {_FILES}
SELECT '/kb/' || folder || '.txt' AS file_path, CASE WHEN NOT ({BROKEN}) THEN 'txt' END AS file_type, CASE WHEN NOT ({BROKEN}) THEN sha256(text) END AS file_hash,
  CASE WHEN NOT ({BROKEN}) THEN CAST(length(text) AS INTEGER) END AS n_chars, {BROKEN} AS failed FROM files
"""

QUERIES = {
    "folder_scan": (folder_scan, _SCAN_SQL),
    "catalog_sync": (catalog_sync, _SYNC_SQL),
    "catalog_index": (catalog_index, _INDEX_SQL),
}
