"""Files as sources: directory scans, text loaders, query sets, vector batches, manifests."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions.text import category, trimmed

TEXT_TYPES = ("md", "txt")
SERVICE_TYPES = {"pdf": "research_report", "md": "markdown", "txt": "text"}
QUERY_SCHEMA = "query string, must_contain array<string>, any_of array<string>"
MODEL_SCHEMA = (
    "struct<model_id:string,model_name:string,model_version:string,dimension:int,runtime:string,precision:string,normalize:boolean,"
    "pooling:string,max_length:int,query_prefix:string,document_prefix:string,config_hash:string>"
)
VECTOR_BATCH_SCHEMA = f"knowledge_base_id string, model_info {MODEL_SCHEMA}, vectors array<struct<chunk_id:string,request_id:string,vector:array<float>>>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def binary_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length, content of all files under ``root``; those that can't be read are left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    return reader.load(root)


def scan(spark: SparkSession, root: str, types: tuple[str, ...] = TEXT_TYPES) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of the text files under ``root``: files (file_path, file_name, file_hash, file_type, text) and, of
    content that isn't UTF-8, errors (file_path, error)."""
    own = binary_files(spark, root).where(extension(F.col("path")).isin(*types))
    rows = own.select(local_path(F.col("path")).alias("file_path"), "content").withColumns(
        {
            "file_name": file_name(F.col("file_path")),
            "file_hash": F.sha2("content", 256),
            "file_type": extension(F.col("file_path")),
            "text": F.try_validate_utf8(F.col("content").cast("string")),
        }
    )
    good = rows.where("text IS NOT NULL").select("file_path", "file_name", "file_hash", "file_type", "text")
    bad = rows.where("text IS NULL").select("file_path", F.concat(F.col("file_path"), F.lit(": not valid UTF-8")).alias("error"))
    return good, bad


def scan_one(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Like ``scan`` for a single file; an unsupported type is an error."""
    if path.rpartition(".")[2].lower() not in TEXT_TYPES:
        raise ValueError(f"unsupported file type: {path}")
    return scan(spark, path)


def parse_documents(files: DataFrame, pdf_text: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc path, title, doc_type, text, error from ``files`` (path, content): pdf, md and txt; others are errors.

    Text of PDFs comes from ``pdf_text``, an expression over the content, for which no library is bundled.
    """
    kind = extension(F.col("path"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in SERVICE_TYPES.items() for x in kv]), kind)
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.when(kind == "pdf", trimmed(pdf_text(F.col("content"))) if pdf_text else F.lit(None).cast("string")).when(label.isNotNull(), plain)
    rows = files.select("path", F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "").alias("title"), label.alias("doc_type"), text.alias("text"), kind.alias("_kind"))
    why = F.when(F.col("_kind") == "pdf", "no PDF extractor").otherwise("not valid UTF-8")
    unknown = F.concat(F.lit("unsupported file type: "), F.col("_kind"))
    error = F.when(F.col("doc_type").isNull(), unknown).when(F.col("text").isNull(), why)
    return rows.select("path", "title", "doc_type", "text", error.alias("error"))


def load_texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """name, text of the files in one folder, in the order of their names."""
    rows = spark.read.option("pathGlobFilter", pattern).text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text")).orderBy("name")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of queries with id ``Q01``.. by position, and category."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.posexplode(F.from_json("value", f"array<struct<{QUERY_SCHEMA.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})).alias("at", "q"))
    return each.select(F.format_string("Q%02d", F.col("at") + 1).alias("id"), "q.*", category(F.col("q.query")).alias("category"))


def vector_batches(rows: DataFrame, column: str = "value") -> DataFrame:
    """knowledge_base_id, model_info, chunk_id, vector of JSON batches; broken JSON is an error."""
    parsed = rows.select(F.from_json(column, VECTOR_BATCH_SCHEMA, {"mode": "FAILFAST"}).alias("b")).select("b.knowledge_base_id", "b.model_info", F.explode("b.vectors").alias("v"))
    return parsed.select("knowledge_base_id", "model_info", "v.chunk_id", "v.vector")


def load_runs(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """Run documents (one JSON object a file) with their path."""
    return spark.read.schema(schema).json(pattern, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def manifest(files: DataFrame) -> DataFrame:
    """path, size_bytes, sha256 of ``files`` (path, length, content), ordered by path."""
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def dataset_hash(files: DataFrame) -> DataFrame:
    """One hash over names and contents: SHA-256 of the sorted (name, SHA-256) lines."""
    lines = files.select(F.concat_ws(" ", file_name(F.col("path")), F.sha2("content", 256)).alias("line"))
    return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("dataset_hash"))  # a line a file


def write_json_atomically(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document: written under another name first, then renamed, on any file system that Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    system = target.getFileSystem(conf)
    stream = system.create(part, True)
    stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    stream.close()
    system.delete(target, False)
    if not system.rename(part, target):
        raise OSError(f"can't rename to {path}")


def write_index(chunks: DataFrame, path: str) -> None:
    """Replaces an index (chunk_id, document, position, content, vector)."""
    chunks.select("chunk_id", "document", "position", "content", "vector").write.mode("overwrite").parquet(path)


def import_summary(parsed: DataFrame) -> DataFrame:
    """One row: succeeded, failed."""
    return parsed.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def numbered(rows: DataFrame, order: list[str], name: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """Numbers from 1 inside each group of ``by``; one task orders a group, or without ``by`` the table, so that should be small."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*(by or [F.lit(1)])).orderBy(*order)))
