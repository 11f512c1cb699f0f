"""A catalog of knowledge bases, documents, chunks, embedding profiles, vectors and index states.

Tables are Parquet. Documents, chunks and vectors are partitioned by a bucket of the document's id, vectors by their
profile too, so a change reads and replaces the buckets of the documents that it touches and nothing else. Merges are
joins: kept rows by anti-join, changed ones by union; cascades are semi- and anti-joins inside the touched buckets. All new
rows of a change are written beside the tables before the first of these is touched, and their partitions are then moved
into place, so a change that fails while it is worked out changes nothing; one writer at a time is assumed, and readers may
see a change's tables one after the other: states first, then documents, chunks and vectors.

A partition that becomes empty keeps one row without an id, which readers don't see. The number of buckets is fixed for
the life of a catalog: choose it so that a bucket is a few files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import recall_query, trimmed
from tessera.functions.vectors import is_finite
from tessera.operators.benchmarks import synthetic_vectors
from tessera.operators.chunking import check_chunking, fixed_windows
from tessera.operators.embedding import QUERY, EmbeddingProvider, ModelInfo, ProviderRegistry, checked_batch
from tessera.operators.retrieval import every_profile_search, vector_search
from tessera.sources.files import extension, file_name, parse_documents
from tessera.sources.tables import written

BUCKETS = 64
#: Files of a large bucket; small ones are one.
FILES = 4
DEFAULT_MODEL = "bge-small"
SCHEMAS = {
    "knowledge_base": "id string, name string, root_path string, chunk_size int, chunk_overlap int, created_at timestamp, updated_at timestamp",
    "document": "id string, knowledge_base_id string, file_path string, file_name string, file_hash string, file_type string, status string, created_at timestamp, updated_at timestamp",
    "chunk": "id string, document_id string, chunk_index int, text string, metadata_json string, created_at timestamp",
    "embedding_profile": (
        "id string, knowledge_base_id string, model_id string, model_name string, model_version string, dimension int, config_hash string, runtime string, "
        "precision string, normalize boolean, pooling string, max_length int, query_prefix string, document_prefix string, created_at timestamp"
    ),
    "vector_record": "chunk_id string, embedding_profile_id string, dimension int, vector array<float>, created_at timestamp",
    "index_state": "knowledge_base_id string, embedding_profile_id string, status string, detail string, updated_at timestamp",
}
#: The partitions of the large tables, and the column that tells their rows from the one that holds a partition open.
PARTITIONS = {"document": ["bucket"], "chunk": ["bucket"], "vector_record": ["embedding_profile_id", "bucket"]}
KEYS = {"document": "id", "chunk": "id", "vector_record": "chunk_id"}
WAITING, STALE, INDEXED, MOCK_INDEXED, EMPTY = "WAITING_EMBEDDING", "STALE", "INDEXED", "MOCK_INDEXED", "EMPTY"


def stable_id(*parts: Column | str) -> Column:
    """A deterministic identifier from columns, in the form of a UUID."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """``target`` with the rows of ``source`` merged in by ``keys``; of a row that was there, ``keep`` columns stay."""
    old = target.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in keep))
    fresh = source.join(old, keys, "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}) if keep else source
    return target.join(source.select(*keys), keys, "left_anti").unionByName(fresh.select(*target.columns))


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def classify(stored: DataFrame, current: DataFrame, keys: list[str], value: str = "file_hash", force: bool = False) -> DataFrame:
    """keys, change (added, updated, unchanged, removed) from a full join of the stored and the current state."""
    old = stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    new = current.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    same = F.col("_old").eqNullSafe(F.col("_new")) & F.lit(not force)
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return old.join(new, keys, "full").select(*keys, change.alias("change"))


def fully_covered(parents: DataFrame, children: DataFrame, covered: DataFrame, parent: str, child: str) -> DataFrame:
    """``parents`` (parent) with at least one of ``children`` (parent, child), all of whose children are ``covered`` (child)."""
    state = children.join(covered.select(child).distinct().withColumn("_has", F.lit(True)), child, "left")
    whole = state.groupBy(parent).agg(F.bool_and(F.coalesce("_has", F.lit(False))).alias("_all")).where("_all")
    return parents.join(whole.select(parent), parent, "left_semi")


def profile_of(profiles: DataFrame, kb_id: str, info: ModelInfo):
    """The profile of a knowledge base whose vectors a model's can be compared with; KeyError if there is none."""
    own = {"knowledge_base_id": kb_id, "model_id": info.model_id, "model_version": info.model_version, "config_hash": info.config_hash}
    found = profiles
    for name, value in own.items():
        found = found.where(F.col(name) == value)
    row = found.orderBy("id").first()
    if row is None:
        raise KeyError(f"knowledge base {kb_id} has no vectors of {info.model_id}; index it first")
    return row


def checked_profile(profiles: DataFrame, kb_id: str, profile_id: str):
    """The profile of that id; ValueError unless it belongs to the knowledge base."""
    row = profiles.where(F.col("id") == profile_id).first()
    if row is None or row.knowledge_base_id != kb_id:
        raise ValueError(f"profile {profile_id} doesn't belong to knowledge base {kb_id}")
    return row


def with_places(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, rank, score, chunk_id, document_id, file_name, file_path, chunk_index, text of ``hits`` (query_id, id, score, rank)."""
    places = documents.select(F.col("id").alias("document_id"), "file_name", "file_path")
    found = hits.withColumnRenamed("id", "chunk_id").join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "text"), "chunk_id")
    return found.join(places, "document_id").select("query_id", "rank", "score", "chunk_id", "document_id", "file_name", "file_path", "chunk_index", "text")


def profile_search(queries: DataFrame, profile, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the best chunks of one ``profile`` (a row with id and dimension) for each of ``queries``
    (query_id, vector); of all vectors, only its partition is read. ValueError for a query without a vector, with another
    dimension, or with values that aren't finite; one row at least, also for k = 0."""
    size = F.coalesce(F.size("vector"), F.lit(-1))
    bad = queries.where(F.col("vector").isNull() | (size != profile.dimension) | (size < 1) | ~is_finite(F.col("vector"))).select("query_id").first()
    if bad is not None:
        raise ValueError(f"query {bad[0]} has no finite vector of dimension {profile.dimension}")
    own = vectors.where(F.col("embedding_profile_id") == profile.id).select(F.col("chunk_id").alias("id"), "vector")
    return vector_search(queries, own, max(k, 1))


class Catalog:
    """Tables under ``path`` with upserts, deletes with cascade, scans and index states."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ---- tables

    def _stored(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """The rows of a table, of the ``touched`` buckets only if given, with their bucket."""
        more = ", bucket int" if name in PARTITIONS else ""
        try:
            rows = self.spark.read.schema(SCHEMAS[name] + more).parquet(f"{self.path}/{name}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], SCHEMAS[name] + more)
        return rows if touched is None else rows.where(F.col("bucket").isin(touched))

    def table(self, name: str) -> DataFrame:
        rows = self._stored(name)
        return rows.where(F.col(KEYS[name]).isNotNull()).drop("bucket") if name in PARTITIONS else rows

    def _bucket(self, document_id: Column | str) -> Column:
        return F.pmod(F.xxhash64(document_id), F.lit(self.buckets)).cast("int")

    def _touched(self, ids: DataFrame) -> list[int]:
        """The buckets of documents (id), no more than there are buckets."""
        return sorted(r.b for r in ids.select(self._bucket("id").alias("b")).distinct().collect())

    def _rows(self, name: str, touched: list[int]) -> DataFrame:
        return self._stored(name, touched).where(F.col(KEYS[name]).isNotNull())

    def _replace(self, old: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """Replaces small tables whole, and of the others the partitions that ``old`` (what they hold so far) and the new rows have."""
        staged = f"{self.path}/_change-{uuid.uuid4().hex}"
        for name, df in tables.items():
            parts = PARTITIONS.get(name, [])
            kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
            own = df.select(*(F.col(f.name).cast(f.dataType) for f in kinds), *(["bucket"] if parts else []))
            if parts:
                # A row without an id in each partition keeps one from staying as it was when nothing is left of it.
                open_ones = [x.select(*parts) for x in ((old or {}).get(name), own) if x is not None]
                held = reduce(DataFrame.unionByName, open_ones).distinct()
                own = own.unionByName(held, allowMissingColumns=True).repartition(*parts, F.pmod(F.xxhash64(KEYS[name]), F.lit(FILES)))
            writer = own.write if parts else own.coalesce(1).write
            (writer.partitionBy(*parts) if parts else writer).parquet(f"{staged}/{name}")
        order = ["knowledge_base", "embedding_profile", "index_state", "document", "chunk", "vector_record"]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        system = path(self.path).getFileSystem(conf)

        def move(source: str, target: str, levels: int) -> None:
            """What is at ``source``, or so many levels of folders below, takes the place of what is at ``target``."""
            if levels:
                system.mkdirs(path(target))
                for folder in (f.getPath().getName() for f in system.listStatus(path(source)) if f.isDirectory()):
                    move(f"{source}/{folder}", f"{target}/{folder}", levels - 1)
                return
            system.delete(path(target), True)
            if not system.rename(path(source), path(target)):
                raise OSError(f"can't rename to {target}")

        for name in sorted(tables, key=order.index):
            move(f"{staged}/{name}", f"{self.path}/{name}", len(PARTITIONS.get(name, [])))
        system.delete(path(staged), True)

    # ---- knowledge bases

    def create(self, name: str, root_path: str, chunk_size: int, chunk_overlap: int) -> str:
        check_chunking(chunk_size, chunk_overlap)
        if not name.strip() or not root_path.strip():
            raise ValueError("name and root_path must not be blank")
        root = root_path.rstrip("/") or "/"
        own = self.table("knowledge_base")
        if not own.where(F.col("root_path") == root).isEmpty():
            raise ValueError(f"there is a knowledge base for {root}")
        kb_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"kb:{root}"))
        row = self.spark.createDataFrame([(kb_id, name.strip(), root, chunk_size, chunk_overlap)], "id string, name string, root_path string, chunk_size int, chunk_overlap int")
        now = F.current_timestamp()
        self._replace(knowledge_base=own.unionByName(row.withColumns({"created_at": now, "updated_at": now})))
        return kb_id

    def knowledge_bases(self) -> DataFrame:
        return self.table("knowledge_base").orderBy(F.desc("created_at"), "id")

    def knowledge_base(self, kb_id: str):
        row = self.table("knowledge_base").where(F.col("id") == kb_id).first()
        if row is None:
            raise KeyError(f"no knowledge base {kb_id}")
        return row

    def delete_knowledge_base(self, kb_id: str) -> None:
        self.knowledge_base(kb_id)
        mine = F.col("knowledge_base_id") == kb_id
        self._drop_documents(
            self.table("document").where(mine).select("id"),
            knowledge_base=self.table("knowledge_base").where(F.col("id") != kb_id),
            embedding_profile=self.table("embedding_profile").where(~mine),
            index_state=self.table("index_state").where(~mine),
        )

    # ---- documents and chunks

    def _drop_documents(self, ids: DataFrame, **others: DataFrame) -> None:
        touched = self._touched(ids)
        gone = ids.select(F.col("id").alias("document_id"))
        documents, chunks, vectors = (self._rows(t, touched) for t in ("document", "chunk", "vector_record"))
        lost = chunks.join(gone, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
        self._replace(
            {"document": documents, "chunk": chunks, "vector_record": vectors},
            document=documents.join(ids, "id", "left_anti"),
            chunk=chunks.join(gone, "document_id", "left_anti"),
            vector_record=vectors.join(lost, "chunk_id", "left_anti"),
            **others,
        )

    def delete_document(self, document_id: str) -> None:
        ids = self.table("document").where(F.col("id") == document_id).select("id")
        if ids.isEmpty():
            raise KeyError(f"no document {document_id}")
        self._drop_documents(ids)

    def sync(self, kb_id: str, files: DataFrame, errors: DataFrame | None = None, force: bool = False, remove: bool = True) -> dict:
        """Brings a knowledge base to the state of ``files`` (file_path, file_name, file_hash, file_type, text).

        ``errors`` (file_path, error) are files that are there but can't be read: what is stored of them stays.
        New and changed documents get new chunks and lose their vectors, and index states turn STALE if there are any;
        documents of paths that are gone are removed. Returns the counts and the errors.
        """
        kb = self.knowledge_base(kb_id)
        stored = self.table("document").where(F.col("knowledge_base_id") == kb_id)
        bad = written(errors, "file-errors") if errors is not None else self.spark.createDataFrame([], "file_path string, error string")
        changes = written(classify(stored.join(bad.select("file_path"), "file_path", "left_anti"), files, ["file_path"], force=force), "changes")
        counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
        dirty = files.join(changes.where("change IN ('added', 'updated')"), "file_path", "left_semi")
        now = F.current_timestamp()
        fresh = written(dirty.select(
            stable_id(F.lit(kb_id), "file_path").alias("id"), F.lit(kb_id).alias("knowledge_base_id"), "file_path", "file_name", "file_hash", "file_type",
            F.lit(WAITING).alias("status"), now.alias("created_at"), now.alias("updated_at"), "text",
        ), "changed-files")
        removed = stored.join(changes.where("change = 'removed'"), "file_path", "left_semi").select("id") if remove else stored.limit(0).select("id")
        pieces = F.posexplode(fixed_windows(F.col("text"), kb.chunk_size, kb.chunk_overlap)).alias("chunk_index", "text")
        chunks = fresh.select(F.col("id").alias("document_id"), F.to_json(F.struct(F.col("file_path").alias("source"))).alias("metadata_json"), pieces).select(
            stable_id("document_id", F.col("chunk_index").cast("string")).alias("id"), "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "text", "metadata_json", now.alias("created_at"),
        )
        n_dirty = counts.get("added", 0) + counts.get("updated", 0)
        if n_dirty or (remove and counts.get("removed", 0)):
            replaced = fresh.select(F.col("id").alias("document_id")).unionByName(removed.select(F.col("id").alias("document_id")))
            touched = self._touched(replaced.withColumnRenamed("document_id", "id"))
            old, held, vectors = (self._rows(t, touched) for t in ("document", "chunk", "vector_record"))
            lost = held.join(replaced, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
            documents = upsert(old.join(removed, "id", "left_anti"), fresh.drop("text").withColumn("bucket", self._bucket("id")), ["knowledge_base_id", "file_path"], ["id", "created_at"])
            state = self.table("index_state")
            mine = (F.col("knowledge_base_id") == kb_id) & F.lit(n_dirty > 0)
            stale = state.withColumns({"status": F.when(mine, STALE).otherwise(F.col("status")), "detail": F.when(mine, "document content changed").otherwise(F.col("detail")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))})
            self._replace(
                {"document": old, "chunk": held, "vector_record": vectors},
                document=documents,
                chunk=held.join(replaced, "document_id", "left_anti").unionByName(chunks.withColumn("bucket", self._bucket("document_id"))),
                vector_record=vectors.join(lost, "chunk_id", "left_anti"),
                index_state=stale,
            )
        new_ids = fresh.select(F.col("id").alias("document_id"))
        made = self.table("chunk").join(new_ids, "document_id", "left_semi").count() if n_dirty else 0
        return {c: counts.get(c, 0) for c in ("added", "updated", "unchanged", "removed")} | {
            "chunks_created": made,
            "errors": [r.error for r in bad.orderBy("file_path").select("error").collect()],
        }

    def add_document(self, kb_id: str, file_path: str, text: str) -> str:
        """Stores one text as a document with its chunks, in place of what is stored for that path; returns its id."""
        if not text.strip():
            raise ValueError("the text is blank")
        name = file_path.rsplit("/", 1)[-1]
        row = self.spark.createDataFrame([(file_path, name, name.rsplit(".", 1)[-1].lower(), text)], "file_path string, file_name string, file_type string, text string")
        self.sync(kb_id, row.withColumn("file_hash", F.sha2("text", 256)), remove=False)
        found = self.table("document").where((F.col("knowledge_base_id") == kb_id) & (F.col("file_path") == file_path))
        return found.first().id

    def add_files(self, kb_id: str, files: DataFrame, provider: EmbeddingProvider | None = None, pdf_text=None) -> DataFrame:
        """Stores ``files`` (path, content) in one change, and the vectors of their chunks if there is a ``provider``.

        A row for each file: file_path, document_id, title, chunk_count, vector_count, error. What can't be parsed, or is
        blank, is an error and isn't stored; chunks without a vector (``provider`` with an error column) make one, too.
        """
        blank = trimmed(F.coalesce("text", F.lit(""))) == ""
        parsed = written(parse_documents(files, pdf_text).withColumn("error", F.coalesce("error", F.when(blank, "the text is blank"))), "parsed-files")
        name, kind = file_name(F.col("path")), extension(F.col("path"))
        good = parsed.where("error IS NULL").dropDuplicates(["path"]).select(F.col("path").alias("file_path"), name.alias("file_name"), F.sha2("text", 256).alias("file_hash"), kind.alias("file_type"), "text")
        self.sync(kb_id, good, remove=False)
        documents = self.table("document").where(F.col("knowledge_base_id") == kb_id).join(good.select("file_path"), "file_path", "left_semi").select("file_path", F.col("id").alias("document_id"))
        documents = written(documents, "added-documents")  # indexing replaces what the tables are read from
        chunks = self.table("chunk").join(documents, "document_id", "left_semi").select(F.col("id").alias("chunk_id"), "document_id", "text")
        own = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.lit(0).cast("long").alias("vector_count"))
        if provider is not None:
            vectors = written(provider.transform(chunks).select("chunk_id", "document_id", "vector"), "file-vectors")
            known = vectors.where("vector IS NOT NULL").select("chunk_id", "vector")
            if not known.isEmpty():
                self.ingest(kb_id, provider.info, known)
            own = vectors.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.count("vector").alias("vector_count"))
        rows = parsed.join(documents, parsed["path"] == documents["file_path"], "left").drop("file_path").join(own, "document_id", "left")
        missing = F.when(F.lit(provider is not None) & (F.col("vector_count") < F.col("chunk_count")), F.concat(F.col("chunk_count") - F.col("vector_count"), F.lit(" chunks have no vector")))
        stored = F.col("error").isNull()
        zero = lambda c: F.when(stored, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
        return written(rows.select(F.col("path").alias("file_path"), F.when(stored, F.col("document_id")).alias("document_id"), "title", zero("chunk_count"), zero("vector_count"), F.coalesce("error", missing).alias("error")), "added-files")

    def delete_chunk(self, chunk_id: str) -> None:
        """Deletes one chunk with its vectors; the others of its document keep their numbers."""
        row = self.table("chunk").where(F.col("id") == chunk_id).first()
        if row is None:
            raise KeyError(f"no chunk {chunk_id}")
        touched = self._touched(self.spark.createDataFrame([(row.document_id,)], "id string"))
        chunks, vectors = (self._rows(t, touched) for t in ("chunk", "vector_record"))
        vectors = vectors.where(F.col("embedding_profile_id").isin([r[0] for r in vectors.where(F.col("chunk_id") == chunk_id).select("embedding_profile_id").collect()]))  # one chunk's
        self._replace({"chunk": chunks, "vector_record": vectors}, chunk=chunks.where(F.col("id") != chunk_id), vector_record=vectors.where(F.col("chunk_id") != chunk_id))

    def reset(self) -> None:
        """Deletes all documents with their chunks and vectors; knowledge bases and profiles stay, their states are EMPTY."""
        state = self.table("index_state").withColumns({"status": F.lit(EMPTY), "detail": F.lit(None).cast("string"), "updated_at": F.current_timestamp()})
        self._drop_documents(self.table("document").select("id"), index_state=state)

    # ---- vectors and index states

    def ingest(self, kb_id: str, info: ModelInfo, vectors: DataFrame, mock: bool = False, every_document: bool = False) -> dict:
        """Stores ``vectors`` (chunk_id, vector) of one embedding space, all or none, and activates that space.

        Documents all of whose chunks have a vector get the new status, or ``every_document`` of the knowledge base.
        """
        self.knowledge_base(kb_id)
        vectors = written(vectors, "vector-batch")  # read by each check and each table; made once
        documents = self.table("document").where(F.col("knowledge_base_id") == kb_id)
        chunks = self.table("chunk").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        checked_batch(vectors, info.dimension, chunks.select(F.col("id").alias("chunk_id")))
        natural = ["knowledge_base_id", "model_id", "model_version", "config_hash"]
        profile_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"profile:{kb_id}:{info.model_id}:{info.model_version}:{info.config_hash}"))
        now = F.current_timestamp()
        fields = {k: getattr(info, k) for k in info.__dataclass_fields__}
        row = self.spark.range(1).select(F.lit(profile_id).alias("id"), F.lit(kb_id).alias("knowledge_base_id"), *(F.lit(v).alias(k) for k, v in fields.items()), now.alias("created_at"))
        profiles = insert_missing(self.table("embedding_profile"), row, natural)
        stored = profiles.where((F.col("id") == profile_id) & (F.col("dimension") != info.dimension))
        if not stored.isEmpty():
            raise ValueError("the stored profile has another dimension")
        touched = self._touched(documents.select("id"))
        owners = chunks.select(F.col("id").alias("chunk_id"), self._bucket("document_id").alias("bucket"))
        records = vectors.dropDuplicates(["chunk_id"]).join(owners, "chunk_id").select("chunk_id", F.lit(profile_id).alias("embedding_profile_id"), F.lit(info.dimension).alias("dimension"), "vector", now.alias("created_at"), "bucket")
        held = self._rows("vector_record", touched).where(F.col("embedding_profile_id") == profile_id)
        every = upsert(held, records, ["chunk_id", "embedding_profile_id"])
        status = MOCK_INDEXED if mock else INDEXED
        state = self.table("index_state")
        other = (F.col("knowledge_base_id") == kb_id) & (F.col("embedding_profile_id") != profile_id)
        staled = state.withColumns({"status": F.when(other, STALE).otherwise(F.col("status")), "detail": F.when(other, "another embedding space was activated").otherwise(F.col("detail")), "updated_at": F.when(other, now).otherwise(F.col("updated_at"))})
        active = self.spark.range(1).select(F.lit(kb_id).alias("knowledge_base_id"), F.lit(profile_id).alias("embedding_profile_id"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("detail"), now.alias("updated_at"))
        covered = held.select("chunk_id").unionByName(vectors.select("chunk_id"))
        done = fully_covered(documents.select(F.col("id").alias("document_id")), chunks.select("document_id", F.col("id").alias("chunk_id")), covered, "document_id", "chunk_id")
        if every_document:
            done = documents.select(F.col("id").alias("document_id"))
        old = self._rows("document", touched)
        marked = old.join(done.select(F.col("document_id").alias("id"), F.lit(True).alias("_done")), "id", "left")
        documents = marked.withColumns({"status": F.when(F.col("_done"), status).otherwise(F.col("status")), "updated_at": F.when(F.col("_done"), now).otherwise(F.col("updated_at"))}).drop("_done")
        inserted = vectors.count()
        self._replace(
            {"document": old, "vector_record": held},
            embedding_profile=profiles, vector_record=every, index_state=upsert(staled, active, ["knowledge_base_id", "embedding_profile_id"]), document=documents,
        )
        return {"profile_id": profile_id, "inserted": inserted, "status": status}

    def index(self, kb_id: str, provider: EmbeddingProvider, mock: bool = False) -> dict:
        """Embeds all chunks of a knowledge base and stores the vectors; ``mock`` marks every document of it."""
        documents = self.table("document").where(F.col("knowledge_base_id") == kb_id)
        chunks = self.table("chunk").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        vectors = provider.transform(chunks.select(F.col("id").alias("chunk_id"), "text")).select("chunk_id", "vector")
        return self.ingest(kb_id, provider.info, vectors, mock, every_document=mock)

    def load_fixture(self, count: int, dimension: int) -> str:
        """Fills an empty catalog with one document of ``count`` chunks and their synthetic vectors, in one change; returns the profile's id."""
        if not self.table("document").isEmpty():
            raise ValueError("the catalog holds documents")
        now, name = F.current_timestamp(), "bench"
        vectors = synthetic_vectors(self.spark, count, dimension).withColumn("bucket", self._bucket(F.lit("doc")))
        size = vectors.select(F.size("vector").alias("n")).first().n
        number = F.substring("id", 2, 10).cast("int")
        one = self.spark.range(1)
        own = lambda **fields: one.select(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))
        self._replace(
            knowledge_base=own(id="kb", name=name, root_path=name, chunk_size=500, chunk_overlap=80, created_at=now, updated_at=now),
            document=own(id="doc", knowledge_base_id="kb", file_path="bench.md", file_name="bench.md", file_hash="hash", file_type="md", status=WAITING, created_at=now, updated_at=now, bucket=self._bucket(F.lit("doc"))),
            embedding_profile=own(id="profile", knowledge_base_id="kb", model_id=name, model_name=name, model_version="1", dimension=size, config_hash=name, runtime="mock", precision="f32", normalize=True, pooling="none", max_length=None, query_prefix=None, document_prefix=None, created_at=now),
            index_state=own(knowledge_base_id="kb", embedding_profile_id="profile", status=INDEXED, detail=None, updated_at=now),
            chunk=vectors.select("id", F.lit("doc").alias("document_id"), number.alias("chunk_index"), F.concat(F.lit("benchmark chunk "), number).alias("text"), F.lit("{}").alias("metadata_json"), now.alias("created_at"), "bucket"),
            vector_record=vectors.select(F.col("id").alias("chunk_id"), F.lit("profile").alias("embedding_profile_id"), F.size("vector").alias("dimension"), "vector", now.alias("created_at"), "bucket"),
        )
        return "profile"

    def delete_vectors(self, document_id: str | None = None, chunk_id: str | None = None, profile_id: str | None = None) -> int:
        """Deletes the vectors of a document, a chunk or a profile, or all; returns how many."""
        records, gone = self._stored("vector_record").where(F.col("chunk_id").isNotNull()), F.lit(True)
        if document_id is not None:
            touched = self._touched(self.spark.createDataFrame([(document_id,)], "id string"))
            ids = self._rows("chunk", touched).where(F.col("document_id") == document_id).select(F.col("id").alias("chunk_id"), F.lit(True).alias("_gone"))
            records = self._rows("vector_record", touched).join(ids, "chunk_id", "left")
            gone = F.coalesce("_gone", F.lit(False))
        elif chunk_id is not None:
            row = self.table("chunk").where(F.col("id") == chunk_id).first()
            touched = [] if row is None else self._touched(self.spark.createDataFrame([(row.document_id,)], "id string"))
            records, gone = self._rows("vector_record", touched), F.col("chunk_id") == chunk_id
        elif profile_id is not None:
            records = records.where(F.col("embedding_profile_id") == profile_id)
        n = records.where(gone).count()
        if n:
            self._replace({"vector_record": records}, vector_record=records.where(~gone))
        return n

    # ---- search

    def search_vectors(self, kb_id: str, profile_id: str, queries: DataFrame, k: int = 5) -> DataFrame:
        """The best chunks of a knowledge base for ``queries`` (query_id, vector) in one of its profiles, with their places."""
        profile = checked_profile(self.table("embedding_profile"), kb_id, profile_id)
        return with_places(profile_search(queries, profile, self.table("vector_record"), k), self.table("chunk"), self.table("document"))

    def search(self, kb_id: str, queries: DataFrame, provider: EmbeddingProvider, k: int = 5) -> DataFrame:
        """The same for ``queries`` (query_id, text) in the profile of the provider's model. ValueError for a blank text."""
        profile = profile_of(self.table("embedding_profile"), kb_id, provider.info)
        blank = queries.where(F.trim(F.coalesce("text", F.lit(""))) == "").first()
        if blank is not None:
            raise ValueError(f"query {blank.query_id} has no text")
        return self.search_vectors(kb_id, profile.id, provider.transform(queries.select("query_id", "text"), input_type=QUERY), k)

    def answer(self, kb_id: str, requests: DataFrame, providers: ProviderRegistry, default_model: str = DEFAULT_MODEL, default_k: int = 5) -> DataFrame:
        """A row for each of ``requests`` (query_id, text, model, top_k; the last two null or left out for the defaults):
        query_id, model, count, error, and results, the places found in the order of their ranks.

        A request without text, for a model that isn't there or that the knowledge base has no vectors of, or whose text
        can't be embedded, has its error and no results; the others aren't touched by it.
        """
        column = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in requests.columns else F.lit(default)
        asked = written(requests.select("query_id", "text", column("model", default_model).alias("model"), column("top_k", default_k).cast("int").alias("top_k")), "requests")
        blank = trimmed(F.coalesce("text", F.lit(""))) == ""
        error = F.when(blank, "query is required").when(~F.col("model").isin(providers.ids()), F.concat(F.lit("no embedding provider "), "model"))
        judged, found, told = asked.withColumn("error", error), None, []
        for model in providers.ids():
            own = judged.where(F.col("error").isNull() & (F.col("model") == model))
            most = own.agg(F.max("top_k")).first()[0]
            if most is None:
                continue
            try:
                profile = profile_of(self.table("embedding_profile"), kb_id, providers.get(model).info)
            except KeyError as missing:
                told.append((model, missing.args[0]))
                continue
            vectors = written(providers.get(model).transform(own, input_type=QUERY), "request-vectors")
            fine = F.col("vector").isNotNull() & (F.size("vector") == profile.dimension) & is_finite(F.col("vector"))
            told_rows = vectors.where(~F.coalesce(fine, F.lit(False))).select("query_id", F.lit("the text can't be embedded").alias("why"))
            hits = self.search_vectors(kb_id, profile.id, vectors.where(fine).select("query_id", "vector"), max(most, 1))
            part = hits.select("query_id", F.struct("rank", "score", "chunk_id", "document_id", "file_name", "file_path", "chunk_index", "text").alias("hit"), F.lit(None).cast("string").alias("why"))
            part = part.unionByName(told_rows, allowMissingColumns=True)
            found = part if found is None else found.unionByName(part)
        gone = self.spark.createDataFrame(told, "model string, why_model string")
        if found is None:
            hit = "struct<rank:int,score:double,chunk_id:string,document_id:string,file_name:string,file_path:string,chunk_index:int,text:string>"
            found = asked.limit(0).select("query_id", F.lit(None).cast(hit).alias("hit"), F.lit(None).cast("string").alias("why"))
        lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list("hit")).alias("hits"), F.max("why").alias("why"))  # the largest top_k at most
        rows = judged.join(F.broadcast(gone), "model", "left").join(lists, "query_id", "left")
        results = F.when(F.col("hits").isNotNull(), F.filter("hits", lambda h: h["rank"] <= F.greatest(F.col("top_k"), F.lit(0)))).otherwise(F.array().cast(lists.schema["hits"].dataType))
        return rows.select("query_id", "model", F.size(results).alias("count"), F.coalesce("error", "why_model", "why").alias("error"), results.alias("results"))

    def recall(self, signals: DataFrame, provider: EmbeddingProvider, k: int = 5) -> DataFrame:
        """The best chunks for ``signals`` (query_id, signal, name, symbol): their template texts, embedded, against the
        vectors of all profiles, those of another dimension scoring 0; ``recall_reason`` is the signal."""
        kind = F.coalesce("signal", F.lit("unknown"))
        texts = signals.select("query_id", recall_query(kind, F.col("name"), F.col("symbol")).alias("text"))
        corpus = self.table("vector_record").select(F.col("chunk_id").alias("id"), "vector")
        hits = every_profile_search(provider.transform(texts, input_type=QUERY), corpus, k, self.table("embedding_profile").count())
        places = with_places(hits, self.table("chunk"), self.table("document"))
        return places.join(signals.select("query_id", kind.alias("recall_reason"), "symbol"), "query_id")
