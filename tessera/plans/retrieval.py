"""Registered queries over the corpus: chunking, embedding, search, fusion, quality and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import segment
from tessera.functions.text import STOP_TERMS, STOP_WORDS, TOKENS, TRIM, category, decoded_url, distinct_terms, recall_query, segments
from tessera.functions.vectors import cosine, from_blob, from_json_text, squared_l2, to_blob, to_json_text
from tessera.operators import catalog, chunking, evaluation, rag, retrieval, views
from tessera.operators.embedding import DIMENSION, HashedNgramProvider
from tessera.sources.files import extension, file_name
from tessera.sources.tables import written

SIZE, OVERLAP, K = 500, 80, 5
DICTIONARY_WORDS = 200_000
STEP = SIZE - OVERLAP


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc_id, chunk_index, text of all documents."""
    made = chunking.chunk_fixed(_read(spark, sf_dir, "documents").select("doc_id", "text"), SIZE, OVERLAP)
    return made.select(F.col("chunk_id").alias("id"), "doc_id", "chunk_index", F.col("content").alias("text"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(df: DataFrame) -> DataFrame:
    return HashedNgramProvider().transform(df)


# ---- chunking


def chunk_fixed(spark, sf_dir):
    return _chunks(spark, sf_dir)


def chunk_sections(spark, sf_dir):
    return chunking.chunk_sections(_read(spark, sf_dir, "documents").select("doc_id", "text"), SIZE)


def chunk_structure(spark, sf_dir):
    return chunking.chunk_structure(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def chunk_pages_structure(spark, sf_dir):
    """Pages with their headings turned into header lines, so sections occur."""
    html = F.regexp_replace(F.col("html"), r"(?s)<(script|style)[^>]*>.*?</\1>", " ")
    lines = F.regexp_replace(F.regexp_replace(html, "<h1[^>]*>", "\n# "), "</h1>|</p>|<br>", "\n\n")
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(lines, "<[^>]*>", "").alias("text"))
    return chunking.chunk_structure(pages, 400, 60)


def representative_texts(spark, sf_dir):
    turns = _read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return chunking.representative_texts(turns, 32)


_CHUNK_CTES = rf"""
cuts AS (
  SELECT doc_id, i, regexp_replace(substr(text, CAST(i * {STEP} + 1 AS BIGINT), {SIZE}), '{TRIM}', '', 'g') AS text
  FROM documents, unnest(range(0, greatest(0, CAST(ceil((length(text) - {SIZE}) / {STEP}.0) AS BIGINT)) + 1)) t(i)
  WHERE length(text) > 0
), chunks AS (
  SELECT doc_id || ':' || chunk_index AS id, * FROM (
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, text FROM cuts WHERE text <> '')
)"""
_SECTIONS_SQL = rf"""
WITH bodies AS (
  SELECT doc_id, regexp_replace(array_to_string(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), chr(10)), '{TRIM}', '', 'g') AS text FROM documents
), cuts AS (
  SELECT doc_id, i, regexp_replace(substr(text, CAST(i * {SIZE} + 1 AS BIGINT), {SIZE}), '{TRIM}', '', 'g') AS content
  FROM bodies, unnest(range(0, greatest(0, CAST(ceil((length(text) - {SIZE}) / {SIZE}.0) AS BIGINT)) + 1)) t(i) WHERE length(text) > 0
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, content FROM cuts WHERE content <> ''
"""
def _structure_sql(source: str, most: int, least: int) -> str:
    """Sections by header lines, long ones cut at sentence ends or packed by paragraphs, short pieces joined on."""
    strip = lambda x: f"regexp_replace({x}, '{TRIM}', '', 'g')"
    return rf"""
WITH RECURSIVE source AS ({source}),
lines AS (
  SELECT doc_id, unnest(l[:-2]) AS line, unnest(range(0, len(l) - 1)) AS i FROM (
    SELECT doc_id, string_split(t || CASE WHEN t LIKE '%' || chr(10) THEN '' ELSE chr(10) END, chr(10)) AS l FROM (SELECT doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM source))
), flagged AS (
  SELECT *, regexp_matches(line, '^[ 	]*#') AS opens, count_if(regexp_matches(line, '^[ 	]*#')) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM lines
), sections AS (
  SELECT doc_id, section, ltrim(coalesce(max(line) FILTER (opens), ''), ' ' || chr(9)) AS header, coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (NOT opens), '') AS body FROM flagged GROUP BY 1, 2
), wholes AS (
  SELECT doc_id, section, {strip("ltrim(header, '#')")} AS name, CASE WHEN section > 0 THEN header || chr(10) || body ELSE body END AS text FROM sections
  WHERE section > 0 OR {strip("body")} <> ''
), paragraphs AS (
  SELECT doc_id, section, p, row_number() OVER (PARTITION BY doc_id, section ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id, section) AS many FROM (
    SELECT doc_id, section, unnest(ps) AS p, unnest(range(0, len(ps))) AS i FROM (SELECT doc_id, section, string_split(text, chr(10) || chr(10)) AS ps FROM wholes WHERE length({strip("text")}) > {most}))
  WHERE {strip("p")} <> ''
), cuts AS (
  SELECT doc_id, section, text, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM wholes
  WHERE length({strip("text")}) > {most} AND (doc_id, section) NOT IN (SELECT doc_id, section FROM paragraphs WHERE many > 1)
  UNION ALL
  SELECT doc_id, section, text, b, CASE WHEN length(text) - b <= {most} THEN length(text)
    WHEN length(regexp_extract(substr(text, b + {most // 2} + 1, {most - most // 2}), '^(?s:.*)[。
；]')) > 0
    THEN b + {most // 2} + length(regexp_extract(substr(text, b + {most // 2} + 1, {most - most // 2}), '^(?s:.*)[。
；]')) ELSE b + {most} END
  FROM cuts WHERE b < length(text)
), packed AS (
  SELECT doc_id, section, p, n, CAST(1 AS BIGINT) AS pack, CAST(length(p) AS BIGINT) AS filled FROM paragraphs WHERE n = 1 AND many > 1
  UNION ALL
  SELECT x.doc_id, x.section, x.p, x.n, CASE WHEN k.filled + 2 + length(x.p) <= {most} THEN k.pack ELSE k.pack + 1 END, CASE WHEN k.filled + 2 + length(x.p) <= {most} THEN k.filled + 2 + length(x.p) ELSE length(x.p) END
  FROM packed k JOIN paragraphs x ON x.doc_id = k.doc_id AND x.section = k.section AND x.n = k.n + 1
), packs AS (
  SELECT doc_id, section, pack, {strip("string_agg(p, chr(10) || chr(10) ORDER BY n)")} AS p, max(pack) OVER (PARTITION BY doc_id, section) AS last FROM packed GROUP BY 1, 2, 3
), joined AS (
  SELECT doc_id, section, CASE WHEN pack = last AND last > 1 AND length(p) < {least} THEN pack - 1 ELSE pack END AS pack, pack AS n, p FROM packs
), pieces AS (
  SELECT doc_id, section, 0 AS n, {strip("text")} AS piece FROM wholes WHERE length({strip("text")}) <= {most}
  UNION ALL SELECT doc_id, section, b, {strip("substr(text, a + 1, b - a)")} FROM cuts WHERE b > a
  UNION ALL SELECT doc_id, section, pack, string_agg(p, chr(10) || chr(10) ORDER BY n) FROM joined GROUP BY 1, 2, 3
), placed AS (
  SELECT doc_id, name, piece, row_number() OVER (PARTITION BY doc_id ORDER BY section, n) AS i FROM pieces JOIN wholes USING (doc_id, section) WHERE piece <> ''
), grouped AS (
  SELECT *, count_if(i = 1 OR length(piece) >= {least}) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM placed
)
SELECT doc_id, CAST(g - 1 AS INTEGER) AS position, arg_min(name, i) AS section, string_agg(piece, chr(10) || chr(10) ORDER BY i) AS content FROM grouped GROUP BY doc_id, g
"""


_PAGES_SOURCE = r"""SELECT page_id AS doc_id, regexp_replace(regexp_replace(regexp_replace(h, '<h1[^>]*>', chr(10) || '# ', 'g'), '</h1>|</p>|<br>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS text
  FROM (SELECT page_id, regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') AS h FROM pages)"""
_REPRESENTATIVE_SQL = rf"""
WITH parts AS (
  SELECT doc_id, unnest(p) AS part, unnest(range(0, len(p))) AS pos
  FROM (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents)
), kept AS (
  SELECT row_number() OVER (ORDER BY doc_id, pos) AS i, regexp_replace(part, '{TRIM}', '', 'g') AS part FROM parts
  WHERE length(regexp_replace(part, '{TRIM}', '', 'g')) >= 20 QUALIFY i <= 32
)
SELECT r.i AS text_index, substr(k.part, 1, 500) AS text
FROM range(0, 32) r(i) JOIN kept k ON k.i = r.i % (SELECT count(*) FROM kept) + 1
"""


# ---- embedding and vector search


def _embedding_ctes(name: str, source: str) -> str:
    return f"""
{name}_grams AS (
  SELECT id, substr(t, CAST(i AS BIGINT), CAST(n AS BIGINT)) AS gram, count(*) AS c
  FROM (SELECT id, lower(text) AS t FROM {source}) s, range(1, 4) g(n), unnest(range(1, length(t) - n + 2)) r(i) GROUP BY ALL
), {name}_hashes AS (
  SELECT gram, CAST('0x' || substr(h, 1, 2) AS INTEGER) % {DIMENSION} AS idx, CASE WHEN CAST('0x' || substr(h, 17, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS sign
  FROM (SELECT gram, sha256(gram) AS h FROM (SELECT DISTINCT gram FROM {name}_grams))
), {name}_sums AS (
  SELECT id, idx, CAST(sum(c * sign) AS DOUBLE) AS x FROM {name}_grams JOIN {name}_hashes USING (gram) GROUP BY id, idx
), {name} AS (
  SELECT id, idx, CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS x FROM {name}_sums
  QUALIFY sum(x * x) OVER (PARTITION BY id) > 0
)"""


_VECTOR_CTES = f"""{_CHUNK_CTES}, asked AS (SELECT item_id AS id, text FROM benchmark), {_embedding_ctes("qv", "asked")}, {_embedding_ctes("cv", "chunks")}, 
norms AS (SELECT id, sqrt(sum(x * x)) AS n FROM cv GROUP BY id), qnorms AS (SELECT id, sqrt(sum(x * x)) AS n FROM qv GROUP BY id),
dots AS (SELECT q.id AS query_id, c.id AS id, sum(q.x * c.x) AS d FROM qv q JOIN cv c USING (idx) GROUP BY 1, 2),
by_vector AS (
  SELECT d.query_id, d.id, round(d.d / (q.n * c.n), 6) AS score FROM dots d JOIN norms c ON c.id = d.id JOIN qnorms q ON q.id = d.query_id
)"""


def embed_chunks(spark, sf_dir):
    """The embeddings of all chunks: a row for each component that isn't 0."""
    rows = _vectors(_chunks(spark, sf_dir)).select("id", F.posexplode("vector").alias("idx", "x"))
    return rows.where("x <> 0").select("id", "idx", F.round(F.col("x").cast("double"), 6).alias("x"))


def search_text(spark, sf_dir):
    """The best chunks for each benchmark text by cosine."""
    chunks, queries = _vectors(_chunks(spark, sf_dir)), _vectors(_queries(spark, sf_dir))
    return retrieval.vector_search(queries, chunks, K).select("query_id", "id", "score", "rank")


def _own_vectors(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("profile"))


def _own_queries(spark, sf_dir):
    """The query set: every vector whose id is divisible by 100."""
    return _own_vectors(spark, sf_dir).where("id % 100 = 0").withColumnRenamed("id", "query_id")


def store_search(spark, sf_dir):
    return retrieval.store_search(_own_queries(spark, sf_dir), _own_vectors(spark, sf_dir), K, "profile").select("query_id", "id", "score", "rank")


def vector_search_all(spark, sf_dir):
    """Over all profiles; vectors of another dimension (every 7th, cut short) score zero."""
    cut = F.when(F.col("id") % 7 == 3, F.slice("vector", 1, 32)).otherwise(F.col("vector"))
    corpus = _own_vectors(spark, sf_dir).withColumn("vector", cut)
    return retrieval.vector_search(_own_queries(spark, sf_dir), corpus, K, "cosine", "zero").select("query_id", "id", "score", "rank")


def vector_search_l2(spark, sf_dir):
    return retrieval.vector_search(_own_queries(spark, sf_dir), _own_vectors(spark, sf_dir), K, "l2").select("query_id", "id", "score", "rank")


def vector_functions(spark, sf_dir):
    """Column functions and codecs over all vectors against the mean of each label."""
    own = _own_vectors(spark, sf_dir)
    first = own.groupBy("profile").agg(F.min_by("vector", "id").alias("other"))
    rows = own.join(first, "profile")
    back = from_json_text(to_json_text(F.col("vector")))
    return rows.select(
        "id",
        F.round(cosine(F.col("vector"), F.col("other")), 6).alias("cosine"),
        F.round(squared_l2(F.col("vector"), F.col("other")), 6).alias("squared_l2"),
        (back == F.col("vector")).alias("json_same"),
        (from_blob(to_blob(F.col("vector"))) == F.col("vector")).alias("blob_same"),
    )


def _list_sql(where: str, score: str, order: str) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, round({score}, 6) AS score FROM q JOIN embeddings ON {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM s)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}
"""


_D = "CAST(embedding AS DOUBLE[])"
_Q = "CAST(qv AS DOUBLE[])"
_COS = f"list_dot_product({_D}, {_Q}) / (sqrt(list_dot_product({_D}, {_D})) * sqrt(list_dot_product({_Q}, {_Q})))"
_L2 = f"list_sum(list_transform(list_zip({_D}, {_Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_FUNCTIONS_SQL = f"""
WITH f AS (SELECT label, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label)
SELECT vec_id AS id, round({_COS}, 6) AS cosine, round({_L2}, 6) AS squared_l2, true AS json_same, true AS blob_same FROM embeddings JOIN f USING (label)
"""


# ---- terms and lexical search


def query_terms(spark, sf_dir):
    return retrieval.query_term_rows(_queries(spark, sf_dir), distinct_terms)


def query_segments(spark, sf_dir):
    return retrieval.query_term_rows(_queries(spark, sf_dir), segments)


def dictionary_segments(spark, sf_dir):
    """The benchmark's texts, written without blanks and marks, cut by a dictionary of the documents' words."""
    known = segment.dictionary(segment.frequent_words(_read(spark, sf_dir, "documents"), DICTIONARY_WORDS))
    joined = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    return _queries(spark, sf_dir).select("query_id", segment.segmenter(known, ())(joined).alias("terms"))


def bm25(spark, sf_dir):
    return retrieval.bm25_search(_queries(spark, sf_dir), _chunks(spark, sf_dir), K).select("query_id", "id", "score", "rank")


def lexical(spark, sf_dir):
    return retrieval.lexical_search(_queries(spark, sf_dir), _chunks(spark, sf_dir), K).select("query_id", "id", "score", "rank")


def analyze(spark, sf_dir):
    return retrieval.analyze_queries(_queries(spark, sf_dir), _chunks(spark, sf_dir))


def hybrid_static(spark, sf_dir):
    chunks, queries = _chunks(spark, sf_dir), _vectors(_queries(spark, sf_dir))
    return retrieval.hybrid_static(queries, _vectors(chunks), K, texts=chunks).select("query_id", "id", "score", "rank")


def hybrid_adaptive(spark, sf_dir):
    chunks, queries = _chunks(spark, sf_dir), _vectors(_queries(spark, sf_dir))
    return retrieval.hybrid_adaptive(queries, _vectors(chunks), K, texts=chunks).select("query_id", "id", "score", "rank")


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_BLANKS = TRIM.split("+")[0][1:]
_TERMS_CTE = rf"""
terms AS (
  SELECT DISTINCT item_id AS query_id, term, CAST(1 AS BIGINT) AS weight FROM (
    SELECT item_id, substr(c, CAST(i AS BIGINT), 2) AS term FROM (SELECT item_id, regexp_replace(text, '{_BLANKS}', '', 'g') AS c FROM benchmark), unnest(range(1, length(c))) r(i)
    UNION ALL SELECT item_id, unnest(regexp_extract_all(text, '{TOKENS}')) FROM benchmark
  ) WHERE term NOT IN ({_quoted(STOP_TERMS)})
)"""
_SEGMENTS_CTE = rf"""
terms AS (
  SELECT query_id, term, count(*) AS weight FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '[\pL\pN]+')) AS term FROM benchmark)
  WHERE length(term) > 1 AND term NOT IN ({_quoted(STOP_WORDS)}) GROUP BY ALL
)"""
_TF_CTES = """
tf AS (
  SELECT term, id, size, CAST((size - length(replace(text, term, ''))) / length(term) AS BIGINT) AS tf
  FROM (SELECT DISTINCT term FROM terms) t JOIN (SELECT id, text, length(text) AS size FROM chunks) c ON contains(c.text, t.term)
), stats AS (
  SELECT term, coalesce(df, 0) AS df, ln(((SELECT count(*) FROM chunks) - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1) AS idf
  FROM (SELECT DISTINCT term FROM terms) LEFT JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)
)"""
_BM25_CTE = """
by_terms AS (
  SELECT query_id, id, round(sum(weight * idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT avg(length(text)) FROM chunks))))), 6) AS score
  FROM terms JOIN stats USING (term) JOIN tf USING (term) GROUP BY 1, 2
)"""
_LEXICAL_CTE = """
by_terms AS (SELECT query_id, id, CAST(sum(tf) AS DOUBLE) AS score FROM terms JOIN tf USING (term) GROUP BY 1, 2)"""
_WEIGHTS_CTE = """
weights AS (
  SELECT b.item_id AS query_id, least(coalesce(m / 3.0, 0.5), 1.0) AS s FROM benchmark b
  LEFT JOIN (SELECT query_id, sum(idf * weight) / sum(weight) AS m FROM terms JOIN stats USING (term) GROUP BY 1) x ON x.query_id = b.item_id
)"""


def _top(source: str, k: int = K, order: str = "DESC") -> str:
    return f"SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM {source}) WHERE rank <= {k}"


def _fused(vector_weight: str, term_weight: str) -> str:
    return f"""
ranks_v AS ({_top("by_vector", 3 * K)}), ranks_t AS ({_top("(SELECT * FROM by_terms WHERE score > 0)", 3 * K)}),
fused AS (
  SELECT query_id, id, round(sum(p), 9) AS score FROM (
    SELECT query_id, id, {vector_weight} / (60 + rank) AS p FROM ranks_v JOIN w USING (query_id)
    UNION ALL SELECT query_id, id, {term_weight} / (60 + rank) FROM ranks_t JOIN w USING (query_id)) GROUP BY 1, 2
) {_top("fused")}"""


_STATIC_SQL = f"WITH {_VECTOR_CTES}, {_TERMS_CTE}, {_TF_CTES}, {_LEXICAL_CTE}, w AS (SELECT item_id AS query_id FROM benchmark), {_fused('0.8', '1.0')}"
_ADAPTIVE_SQL = f"WITH {_VECTOR_CTES}, {_SEGMENTS_CTE}, {_TF_CTES}, {_BM25_CTE}, {_WEIGHTS_CTE}, w AS (SELECT * FROM weights), {_fused('(1.0 - 0.6 * s)', '(0.4 + 0.8 * s)')}"
_ANALYZE_SQL = f"""WITH {_CHUNK_CTES}, {_SEGMENTS_CTE}, {_TF_CTES}, {_WEIGHTS_CTE}
SELECT w.query_id, t.term, CAST(df AS BIGINT) AS doc_freq, printf('%.3f', round(idf, 3)) AS idf, printf('%.3f', round(s, 3)) AS specificity,
       printf('%.3f', round(1.0 - 0.6 * s, 3)) AS vector_weight, printf('%.3f', round(0.4 + 0.8 * s, 3)) AS bm25_weight
FROM weights w LEFT JOIN terms t USING (query_id) LEFT JOIN stats USING (term)
"""


# ---- search over a catalog's tables


def _active(spark, sf_dir):
    """The chunks that a service ranks: every third document isn't active, every fourth chunk has no vector."""
    chunks = _chunks(spark, sf_dir).withColumn("document_id", F.col("doc_id"))
    status = F.when(F.col("doc_id") % 3 == 1, "deleted").otherwise("active")
    documents = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), status.alias("status"))
    stored = chunks.where("chunk_index % 4 <> 3").select(F.col("id").alias("chunk_id"))
    return views.searchable_chunks(chunks, documents, stored).select("id", "doc_id", "chunk_index", "text")


_ACTIVE_CTES = _CHUNK_CTES.replace("chunks AS (", "every AS (") + """, chunks AS (SELECT * FROM every WHERE doc_id % 3 <> 1 AND chunk_index % 4 <> 3)"""
_SERVICE_SQL = _ADAPTIVE_SQL.replace(_CHUNK_CTES, _ACTIVE_CTES)


def service_search(spark, sf_dir):
    """The adaptive hybrid search over active documents' chunks with a vector."""
    chunks, queries = _active(spark, sf_dir), _vectors(_queries(spark, sf_dir))
    return retrieval.hybrid_adaptive(queries, _vectors(chunks), K, texts=chunks).select("query_id", "id", "score", "rank")


def profile_search(spark, sf_dir):
    """Sources as knowledge bases, each with a profile: the search of the first one's chunks, with their places."""
    info, chunks, docs = HashedNgramProvider().info, _chunks(spark, sf_dir), _read(spark, sf_dir, "documents").select("doc_id", "source")
    kb_id = docs.agg(F.min("source")).first()[0]
    fields = {k: F.lit(getattr(info, k)) for k in ("model_id", "model_version", "config_hash", "dimension")}
    name = F.concat(F.lit("profile-"), "source")
    profiles = docs.select(name.alias("id"), F.col("source").alias("knowledge_base_id")).distinct().withColumns(fields)
    vectors = _vectors(chunks.join(docs, "doc_id").select(F.col("id").alias("chunk_id"), name.alias("embedding_profile_id"), "text")).drop("text")
    profile = catalog.checked_profile(profiles, kb_id, catalog.profile_of(profiles, kb_id, info).id)
    hits = catalog.profile_search(_vectors(_queries(spark, sf_dir)), profile, vectors, K)
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))
    documents = docs.select(F.col("doc_id").alias("id"), F.concat("doc_id", F.lit(".md")).alias("file_name"), path.alias("file_path"))
    return catalog.with_places(hits, chunks.withColumnRenamed("doc_id", "document_id"), documents)


_PROFILE_SQL = f"""WITH {_VECTOR_CTES.replace(_CHUNK_CTES, _CHUNK_CTES.replace("chunks AS (", "every AS (") + ", chunks AS (SELECT e.*, source FROM every e JOIN documents USING (doc_id) WHERE source = (SELECT min(source) FROM documents))")},
hits AS ({_top("by_vector")})
SELECT query_id, rank, score, id AS chunk_id, doc_id AS document_id, doc_id || '.md' AS file_name, source || '/' || doc_id || '.md' AS file_path, chunk_index, text FROM hits JOIN chunks USING (id)
"""


_SIGNALS = {"click": "price_surge", "view": "price_drop", "purchase": "volume_anomaly"}


def _signals(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for kv in _SIGNALS.items() for x in kv])
    own = _read(spark, sf_dir, "events").select("event_id", F.element_at(kinds, F.col("event_type")).alias("signal"), F.concat(F.lit("u"), "user_id").alias("name"))
    return own.select("event_id", F.coalesce("signal", F.lit("unknown")).alias("signal"), "name", F.lit("S").alias("symbol"))


def signal_recall(spark, sf_dir):
    """The best active chunks for the signals of every event whose id is divisible by 100."""
    texts = _signals(spark, sf_dir).where("event_id % 100 = 0").select(F.col("event_id").alias("query_id"), recall_query(F.col("signal"), F.col("name"), F.col("symbol")).alias("text"))
    return retrieval.every_profile_search(_vectors(texts), _vectors(_active(spark, sf_dir)), K, 1).select("query_id", "id", "score", "rank")


# ---- quality and context


def _rules(spark, sf_dir):
    """A rule per benchmark text: its first segment, and one of the two next."""
    own = _queries(spark, sf_dir).select("query_id", segments(F.col("text")).alias("s"))
    return own.select("query_id", F.slice("s", 1, 1).alias("must_contain"), F.slice("s", 2, 2).alias("any_of"))


def _labelled(spark, sf_dir):
    """The rules, and the ten best chunks of each query with what they say of them, at three k."""
    rules, chunks = _rules(spark, sf_dir), _chunks(spark, sf_dir)
    hits = retrieval.bm25_search(_queries(spark, sf_dir), chunks, 10)
    places = chunks.select("id", "text", F.col("doc_id").alias("document"))
    ks = F.explode(F.array(*map(F.lit, (3, 5, 10)))).alias("top_k")
    return rules, chunks, evaluation.labelled_hits(hits.join(places, "id"), rules).select("*", ks).where("rank <= top_k")


def _details(spark, sf_dir):
    rules, chunks, at_k = _labelled(spark, sf_dir)
    ks = F.explode(F.array(*map(F.lit, (3, 5, 10)))).alias("top_k")
    totals = evaluation.total_relevant(rules, chunks).select("query_id", "total_relevant", ks)
    return evaluation.quality_details(at_k.select("query_id", "rank", "relevant", "top_k"), totals, ("top_k",))


def quality_results(spark, sf_dir):
    """The ranked results that a query's details carry, a row for each."""
    hits = written(_labelled(spark, sf_dir)[2], "labelled-hits")
    details = evaluation.with_results(hits.select("query_id", "top_k").distinct(), hits, ("top_k",))
    rows = details.select("query_id", "top_k", F.posexplode("results").alias("place", "hit"))
    return rows.select("query_id", "top_k", F.col("place").cast("int").alias("place"), "hit.*")


def quality_details(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall", "precision", "ndcg", "average_precision")]
    return _details(spark, sf_dir).select("query_id", "top_k", "hit", "first_relevant_rank", *rounded, "retrieved_relevant", "total_relevant")


def quality_summary(spark, sf_dir):
    out = evaluation.quality_summary(_details(spark, sf_dir), ("top_k",))
    return out.select("top_k", "query_count", *(F.round(c, 6).alias(c) for c in evaluation.METRICS))


_DETAILS_CTES = rf"""{_CHUNK_CTES}, {_SEGMENTS_CTE}, {_TF_CTES}, {_BM25_CTE}, hits AS ({_top("by_terms", 10)}),
rules AS (
  SELECT item_id AS query_id, s[1:1] AS must, s[2:3] AS alt FROM (
    SELECT item_id, list_filter(regexp_extract_all(text, '[\pL\pN]+'), lambda t: length(t) > 1 AND t NOT IN ({_quoted(STOP_WORDS)})) AS s FROM benchmark)
), relevant AS (
  SELECT query_id, id FROM rules JOIN chunks ON len(list_filter(must, lambda t: NOT contains(text, t))) = 0 AND (len(alt) = 0 OR len(list_filter(alt, lambda t: contains(text, t))) > 0)
), totals AS (
  SELECT query_id, count(r.id) AS total FROM rules LEFT JOIN relevant r USING (query_id) GROUP BY 1
), each AS (
  SELECT h.query_id, k.top_k, h.rank, (r.id IS NOT NULL) AS rel,
         sum(CASE WHEN r.id IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY h.query_id, k.top_k ORDER BY h.rank ROWS UNBOUNDED PRECEDING) AS seen
  FROM hits h JOIN (SELECT unnest([3, 5, 10]) AS top_k) k ON h.rank <= k.top_k LEFT JOIN relevant r ON r.query_id = h.query_id AND r.id = h.id
), found AS (
  SELECT query_id, top_k, min(CASE WHEN rel THEN rank END) AS first, count(*) AS n, count_if(rel) AS got, sum(CASE WHEN rel THEN 1 / log2(rank + 1) END) AS dcg,
         sum(CASE WHEN rel THEN seen / rank END) AS prec FROM each GROUP BY 1, 2
), details AS (
  SELECT t.query_id, k.top_k, CASE WHEN first > 0 THEN 1 ELSE 0 END AS hit, coalesce(first, 0) AS first_relevant_rank, coalesce(1.0 / first, 0) AS reciprocal_rank,
         CASE WHEN total > 0 THEN coalesce(got, 0) / total ELSE 0 END AS recall, coalesce(got / n, 0) AS precision,
         coalesce(dcg / list_sum(list_transform(range(1, CAST(least(total, n) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg,
         CASE WHEN least(total, coalesce(n, 0)) > 0 THEN coalesce(prec, 0) / least(total, n) ELSE 0 END AS average_precision, coalesce(got, 0) AS got, total
  FROM totals t CROSS JOIN (SELECT unnest([3, 5, 10]) AS top_k) k LEFT JOIN found f ON f.query_id = t.query_id AND f.top_k = k.top_k
)"""
_DETAILS_SQL = f"""WITH {_DETAILS_CTES}
SELECT query_id, top_k, hit, CAST(first_relevant_rank AS INTEGER) AS first_relevant_rank, round(reciprocal_rank, 6) AS reciprocal_rank, round(recall, 6) AS recall,
       round(precision, 6) AS precision, round(ndcg, 6) AS ndcg, round(average_precision, 6) AS average_precision, CAST(got AS INTEGER) AS retrieved_relevant, CAST(total AS INTEGER) AS total_relevant
FROM details
"""
_RESULTS_SQL = f"""WITH {_DETAILS_CTES}
SELECT h.query_id, k.top_k, CAST(h.rank - 1 AS INTEGER) AS place, h.rank, h.id AS chunk_id, c.doc_id AS document, sha256(c.text) AS content_sha256, (r.id IS NOT NULL) AS relevant, h.score
FROM hits h JOIN (SELECT unnest([3, 5, 10]) AS top_k) k ON h.rank <= k.top_k JOIN chunks c ON c.id = h.id LEFT JOIN relevant r ON r.query_id = h.query_id AND r.id = h.id
"""
_SUMMARY_SQL = f"""WITH {_DETAILS_CTES}
SELECT top_k, count(*) AS query_count, round(avg(hit), 6) AS hit_rate, round(avg(reciprocal_rank), 6) AS mrr, round(avg(recall), 6) AS recall,
       round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg, round(avg(average_precision), 6) AS map FROM details GROUP BY top_k
"""


def rag_contexts(spark, sf_dir):
    """Prompts with the three best chunks of each benchmark text."""
    chunks, queries = _chunks(spark, sf_dir), _queries(spark, sf_dir)
    hits = retrieval.hydrated(retrieval.bm25_search(queries, chunks, 3), chunks.withColumn("file_name", F.concat(F.lit("doc"), "doc_id", F.lit(".md"))))
    return rag.answers(queries, hits, mock=True).select("query_id", "prompt", "llm_used")


_RAG_SQL = f"""WITH {_CHUNK_CTES}, {_SEGMENTS_CTE}, {_TF_CTES}, {_BM25_CTE}, hits AS ({_top("by_terms", 3)}),
contexts AS (
  SELECT query_id, string_agg('[资料' || rank || ' | doc' || doc_id || '.md | chunk ' || chunk_index || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN chunks USING (id) GROUP BY 1
)
SELECT item_id AS query_id, '问题：' || text || chr(10) || chr(10) || '本地资料：' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '请给出简洁回答并引用资料编号。' AS prompt, false AS llm_used
FROM benchmark LEFT JOIN contexts ON query_id = item_id
"""


def context_evidence(spark, sf_dir):
    return rag.context_evidence(_chunks(spark, sf_dir), 3, ["doc_id", "chunk_index"])


_EVIDENCE_SQL = f"""WITH {_CHUNK_CTES}, first AS (SELECT * FROM chunks ORDER BY doc_id, chunk_index LIMIT 3),
c AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY doc_id, chunk_index) AS context FROM first)
SELECT context, sha256(context) AS sha256, CAST(length(context) AS INTEGER) AS n_chars FROM c
"""


# ---- smaller text operators


def categories(spark, sf_dir):
    """The first matching word list of each turn, counted."""
    rules = {"thanks": ["that", "than"], "query": ["que", "qui"], "other_half": ["und", "der"]}
    own = _read(spark, sf_dir, "conversations").select("role", category(F.col("text"), rules, "rest").alias("category"))
    return own.groupBy("role", "category").agg(F.count(F.lit(1)).alias("n"))


def recall_queries(spark, sf_dir):
    return _signals(spark, sf_dir).select("event_id", recall_query(F.col("signal"), F.col("name"), F.col("symbol")).alias("query"))


def page_paths(spark, sf_dir):
    """Decoded page addresses with file name and type."""
    url = F.replace("url", F.lit("/en/"), F.lit("/e%6E+a/"))
    return _read(spark, sf_dir, "pages").select("page_id", decoded_url(url).alias("decoded"), file_name(F.col("url")).alias("file_name"), extension(F.col("url")).alias("file_type"))


_CATEGORY_SQL = """
SELECT role, CASE WHEN contains(text, 'that') OR contains(text, 'than') THEN 'thanks' WHEN contains(text, 'que') OR contains(text, 'qui') THEN 'query'
                  WHEN contains(text, 'und') OR contains(text, 'der') THEN 'other_half' ELSE 'rest' END AS category, count(*) AS n
FROM conversations GROUP BY 1, 2
"""
_RECALL_SQL = """
SELECT event_id, CASE event_type WHEN 'click' THEN 'u' || user_id || ' 涨幅 原因 分析 利好' WHEN 'view' THEN 'u' || user_id || ' 下跌 风险 利空 跟踪'
                                 WHEN 'purchase' THEN 'u' || user_id || ' 成交量 异动 资金' ELSE 'u' || user_id || ' S 分析' END AS query FROM events
"""
_SIGNAL_SQL = "WITH " + _VECTOR_CTES.replace(_CHUNK_CTES, _ACTIVE_CTES).replace(
    "asked AS (SELECT item_id AS id, text FROM benchmark)", f"asked AS (SELECT event_id AS id, query AS text FROM ({_RECALL_SQL}) WHERE event_id % 100 = 0)"
) + _top("by_vector")
_PATHS_SQL = r"""
SELECT page_id, replace(url, '/en/', '/en a/') AS decoded, list_last(string_split(url, '/')) AS file_name, lower(regexp_extract(url, '\.([^./\\]+)$', 1)) AS file_type FROM pages
"""

QUERIES = {
    "chunk_fixed": (chunk_fixed, f"WITH {_CHUNK_CTES} SELECT id, doc_id, chunk_index, text FROM chunks"),
    "chunk_sections": (chunk_sections, _SECTIONS_SQL),
    "chunk_structure": (chunk_structure, _structure_sql("SELECT doc_id, text FROM documents", chunking.MAX_SIZE, chunking.MIN_SIZE)),
    "chunk_pages_structure": (chunk_pages_structure, _structure_sql(_PAGES_SOURCE, 400, 60)),
    "representative_texts": (representative_texts, _REPRESENTATIVE_SQL),
    "embed_chunks": (embed_chunks, f"WITH {_CHUNK_CTES}, {_embedding_ctes('cv', 'chunks')} SELECT id, CAST(idx AS INTEGER) AS idx, round(x, 6) AS x FROM cv WHERE x <> 0"),
    "search_text": (search_text, f"WITH {_VECTOR_CTES} {_top('by_vector')}"),
    "store_search": (store_search, _list_sql("label = ql", _COS, "DESC")),
    "vector_search_all": (vector_search_all, _list_sql("true", f"CASE WHEN vec_id % 7 = 3 THEN 0.0 ELSE {_COS} END", "DESC")),
    "vector_search_l2": (vector_search_l2, _list_sql("true", _L2, "ASC")),
    "vector_functions": (vector_functions, _FUNCTIONS_SQL),
    "query_terms": (query_terms, f"WITH {_TERMS_CTE} SELECT * FROM terms"),
    "query_segments": (query_segments, f"WITH {_SEGMENTS_CTE} SELECT * FROM terms"),
    "dictionary_segments": (dictionary_segments, None),
    "bm25": (bm25, f"WITH {_CHUNK_CTES}, {_SEGMENTS_CTE}, {_TF_CTES}, {_BM25_CTE} {_top('(SELECT * FROM by_terms WHERE score > 0)')}"),
    "lexical": (lexical, f"WITH {_CHUNK_CTES}, {_TERMS_CTE}, {_TF_CTES}, {_LEXICAL_CTE} {_top('by_terms')}"),
    "analyze": (analyze, _ANALYZE_SQL),
    "hybrid_static": (hybrid_static, _STATIC_SQL),
    "hybrid_adaptive": (hybrid_adaptive, _ADAPTIVE_SQL),
    "service_search": (service_search, _SERVICE_SQL),
    "profile_search": (profile_search, _PROFILE_SQL),
    "signal_recall": (signal_recall, _SIGNAL_SQL),
    "quality_details": (quality_details, _DETAILS_SQL),
    "quality_results": (quality_results, _RESULTS_SQL),
    "quality_summary": (quality_summary, _SUMMARY_SQL),
    "rag_contexts": (rag_contexts, _RAG_SQL),
    "context_evidence": (context_evidence, _EVIDENCE_SQL),
    "categories": (categories, _CATEGORY_SQL),
    "recall_queries": (recall_queries, _RECALL_SQL),
    "page_paths": (page_paths, _PATHS_SQL),
}
