"""Registered queries over samples and relational tables: statistics, benchmark analytics, catalog operations.

Orders and line items play documents and chunks where a query is about the relations between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stats import cpu_percent, entropy_scores, memory_needed_gib, quality_score
from tessera.functions.stats import resource_summary as resources
from tessera.operators import benchmarks, catalog, evaluation, views
from tessera.operators.latency import latency_table
from tessera.streaming.watch import latency_windows as windows


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _samples(spark, sf_dir):
    """Events as latency samples; errors are failed ones."""
    own = _read(spark, sf_dir, "events")
    return own.select(
        "event_id", "ts", "user_id", "event_type", F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"),
        (F.col("user_id") % 5).alias("round"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.concat(F.lit("c"), F.col("user_id") % 7).alias("chunk_config"),
    )


_SAMPLES = """
samples AS (
  SELECT event_id, ts, user_id, event_type, value AS latency_ms, event_type <> 'error' AS success, user_id % 5 AS round, 'm' || (user_id % 3) AS model, 'c' || (user_id % 7) AS chunk_config FROM events
)"""
_SUMMARY = """count(*) AS total_samples, count_if(success AND latency_ms IS NOT NULL) AS successful_samples, count(*) - count_if(success AND latency_ms IS NOT NULL) AS failed_samples,
  round(avg(latency_ms) FILTER (success), 6) AS mean_ms, round(min(latency_ms) FILTER (success), 6) AS min_ms, round(max(latency_ms) FILTER (success), 6) AS max_ms,
  round(quantile_cont(latency_ms, 0.5) FILTER (success), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95) FILTER (success), 6) AS p95_ms"""


def latency_by_model(spark, sf_dir):
    return latency_table(_samples(spark, sf_dir), ["model", "chunk_config"])


def latency_grouping_sets(spark, sf_dir):
    """The complete summary by model, by round and over all, in the same passes."""
    return latency_table(_samples(spark, sf_dir), ["model", "round"], always_p99=True, sets=[["model"], ["round"], []])


def throughput(spark, sf_dir):
    own = _samples(spark, sf_dir).where("success")
    counted = own.withColumns({"text_count": F.col("round") + 1, "token_count": F.length("event_type"), "vector_count": F.col("round") + 1})
    return _rounded(benchmarks.throughput(counted, ["model", "round"]), 4)


def queries_per_second(spark, sf_dir):
    return _rounded(benchmarks.queries_per_second(_samples(spark, sf_dir), ["model"]))


def _resource_samples(spark, sf_dir):
    own = _read(spark, sf_dir, "events").select(
        F.col("user_id").alias("pid"), F.floor(F.col("event_id") / 4).alias("sample_index"), "event_id", "value", (F.col("user_id") % 3).alias("profile")
    )
    once = own.groupBy("pid", "sample_index", "profile").agg(F.round(F.sum("value"), 4).alias("cpu_seconds"), F.sum(F.col("event_id") * 1000).alias("working_set_bytes"), F.max("event_id").alias("private_bytes"))
    return once


def cpu_usage(spark, sf_dir):
    out = cpu_percent(_resource_samples(spark, sf_dir), 8, 500)
    return out.select("pid", "sample_index", F.round("cpu_pct", 6).alias("cpu_pct"))


def resource_summary(spark, sf_dir):
    return _rounded(resources(cpu_percent(_resource_samples(spark, sf_dir), 8, 500), ["profile"]))


_RESOURCES = """
once AS (
  SELECT user_id AS pid, event_id // 4 AS sample_index, user_id % 3 AS profile, round(sum(value), 4) AS cpu_seconds, CAST(sum(event_id * 1000) AS BIGINT) AS w, max(event_id) AS p FROM events GROUP BY ALL
), used AS (
  SELECT *, greatest(0.0, (cpu_seconds - lag(cpu_seconds) OVER o) / ((sample_index - lag(sample_index) OVER o) * 0.5 * 8) * 100.0) AS cpu_pct,
         lag(sample_index) OVER o AS prior FROM once WINDOW o AS (PARTITION BY pid ORDER BY sample_index)
), cpu AS (SELECT * EXCLUDE (cpu_pct), CASE WHEN prior IS NOT NULL THEN cpu_pct END AS cpu_pct FROM used)"""


def _points(spark, sf_dir):
    own = latency_table(_samples(spark, sf_dir).withColumnRenamed("model", "profile"), ["profile", "chunk_config"])
    return own.select("profile", "chunk_config", "p50_ms", "p95_ms", (1000.0 / F.col("mean_ms")).alias("qps_sequential"))


def entropy_weights(spark, sf_dir):
    out = entropy_scores(_points(spark, sf_dir), ["profile"])
    return _rounded(out.select("profile", "chunk_config", "w_p50_cost", "w_p95_cost", "w_qps", "entropy_score"), 5)


def _quality_rows(spark, sf_dir):
    """Three columns of numbers by source, where a report has its quality measures: labels and lengths stand in for them, as
    these tables hold no measured quality. Only the arithmetic of the scores is tested with them."""
    labels = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return labels.groupBy("source").agg(F.avg("quality").alias("recall"), F.avg("toxic").alias("mrr"), F.avg(F.col("n_chars") % 10).alias("ndcg"))


def quality_scores(spark, sf_dir):
    return _rounded(quality_score(_quality_rows(spark, sf_dir)).select("source", "quality_score"))


def memory_estimate(spark, sf_dir):
    own = _read(spark, sf_dir, "documents").groupBy("source").agg((F.sum("n_chars") * 150000).alias("peak"))
    return own.select("source", memory_needed_gib(F.col("peak")).alias("gib"))


def recommended_chunking(spark, sf_dir):
    rows = _quality_rows(spark, sf_dir).select(F.col("source").alias("chunk_config"), "ndcg", F.lit("fixed").alias("strategy"), F.lit(3).alias("top_k"))
    return benchmarks.recommended_fixed(rows)


def model_ratios(spark, sf_dir):
    own = latency_table(_samples(spark, sf_dir), ["chunk_config", "model"])
    return _rounded(benchmarks.ratios(own.select("chunk_config", "model", "mean_ms"), ["chunk_config"], "mean_ms", "model", "m0"))


def model_comparison(spark, sf_dir):
    own = latency_table(_samples(spark, sf_dir), ["chunk_config", "model"])
    return evaluation.compared(own, "chunk_config", "model", ["m0", "m1", "m2"], "p50_ms")


def result_overlap(spark, sf_dir):
    """Each user's five slowest against its five latest events."""
    own = _read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    best = lambda order: evaluation_top(own, order).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"]).alias("ids"))
    left, right = best([F.desc("value"), "event_id"]), best([F.desc("event_id")])
    return _rounded(benchmarks.result_overlap(left.withColumn("band", F.col("user_id") % 4), right, ["user_id"], ["band"], 5))


def evaluation_top(rows: DataFrame, order: list, k: int = 5) -> DataFrame:
    from pyspark.sql import Window as W

    return rows.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy(*order))).where(F.col("n") <= k)


def hardware_matrix(spark, sf_dir):
    """Regions as profiles, languages as models, line states as fixed configurations, three k."""
    profiles = _read(spark, sf_dir, "region").select(F.col("r_name").alias("profile"))
    models = _read(spark, sf_dir, "documents").select(F.col("lang").alias("model")).distinct()
    configs = _read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("chunk_config")).distinct().withColumn("strategy", F.when(F.col("chunk_config") < "R", "fixed").otherwise("structure"))
    ks = spark.range(1).select(F.explode(F.array(*map(F.lit, (3, 5, 10)))).alias("top_k"))
    return benchmarks.hardware_matrix(profiles, models, configs, ks)


def request_sequence(spark, sf_dir):
    queries = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return benchmarks.request_sequence(queries, 334, 20260907)


def sample_count_errors(spark, sf_dir):
    """Runs (users) whose recorded counts, off by one for every ninth, don't match."""
    own = _samples(spark, sf_dir).withColumnRenamed("user_id", "run_id")
    told = own.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_samples"), F.count_if("success").alias("successful_samples"), F.count_if(~F.col("success")).alias("failed_samples"))
    off = told.withColumn("total_samples", F.col("total_samples") + F.when(F.col("run_id") % 9 == 0, 1).otherwise(0))
    return benchmarks.sample_count_errors(off, own.select("run_id", "success", "latency_ms"))


def successful_summary(spark, sf_dir):
    own = _samples(spark, sf_dir).withColumns({"hit": (F.col("event_id") % 3 == 0).cast("int"), "reciprocal_rank": 1.0 / (F.col("event_id") % 4 + 1)})
    return _rounded(evaluation.successful_summary(own, ("model",)))


def first_seen(spark, sf_dir):
    own = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return evaluation.first_per_key(own, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def latency_windows(spark, sf_dir):
    out = windows(_read(spark, sf_dir, "events"), "1 hour")
    return _rounded(out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "samples", "succeeded", "mean_ms", "max_ms"))


# ---- catalog


def _documents(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("knowledge_base_id"), F.col("o_orderpriority").alias("file_name"), F.col("o_orderstatus").alias("status"))


def _chunk_rows(spark, sf_dir):
    item = _read(spark, sf_dir, "lineitem")
    return item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.concat("l_returnflag", "l_linestatus").alias("text"), "l_returnflag")


def _vector_rows(spark, sf_dir):
    own = _chunk_rows(spark, sf_dir).where("l_returnflag <> 'R'")
    return own.select(F.col("id").alias("chunk_id"), F.col("text").alias("embedding_profile_id"))


_CATALOG = """
documents_ AS (SELECT o_orderkey AS id, o_custkey AS knowledge_base_id, o_orderpriority AS file_name, o_orderstatus AS status FROM orders),
chunks_ AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS document_id, l_linenumber AS chunk_index, l_returnflag || l_linestatus AS text, l_returnflag FROM lineitem),
vectors_ AS (SELECT id AS chunk_id, text AS embedding_profile_id FROM chunks_ WHERE l_returnflag <> 'R')"""


def document_listing(spark, sf_dir):
    return views.document_listing(_documents(spark, sf_dir), _chunk_rows(spark, sf_dir), _vector_rows(spark, sf_dir))


def chunk_listing(spark, sf_dir):
    return views.chunk_listing(_chunk_rows(spark, sf_dir), _documents(spark, sf_dir))


def searchable_chunks(spark, sf_dir):
    """Chunks of active documents with a vector; other documents and chunks are in the tables, too."""
    docs = _documents(spark, sf_dir).withColumn("status", F.when(F.col("status") == "O", "active").otherwise("deleted"))
    found = views.searchable_chunks(_chunk_rows(spark, sf_dir), docs, _vector_rows(spark, sf_dir))
    return found.select("id", "document_id", "chunk_index", "text")


def covered_documents(spark, sf_dir):
    """Documents with at least one chunk, all of whose chunks have a vector."""
    parents = _documents(spark, sf_dir).select(F.col("id").alias("document_id"))
    children = _chunk_rows(spark, sf_dir).select("document_id", F.col("id").alias("chunk_id"))
    return catalog.fully_covered(parents, children, _vector_rows(spark, sf_dir), "document_id", "chunk_id")


def profile_listing(spark, sf_dir):
    profiles = _vector_rows(spark, sf_dir).select(F.col("embedding_profile_id").alias("id")).distinct().withColumn("knowledge_base_id", F.lit("kb"))
    states = profiles.where("id < 'N'").select("knowledge_base_id", F.col("id").alias("embedding_profile_id"), F.lit("INDEXED").alias("status"))
    return views.profile_listing(profiles, states, _vector_rows(spark, sf_dir), "kb")


def dashboard(spark, sf_dir):
    kbs = _read(spark, sf_dir, "customer")
    profiles = _vector_rows(spark, sf_dir).select(F.col("embedding_profile_id").alias("id")).distinct().withColumn("runtime", F.lit("rust-mock"))
    states = _read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("embedding_profile_id"))
    return views.dashboard(kbs, _documents(spark, sf_dir), _chunk_rows(spark, sf_dir), _vector_rows(spark, sf_dir), states, profiles)


def service_statistics(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("status", F.when(F.col("status") == "O", "active").otherwise("deleted"))
    return views.service_statistics(docs, _chunk_rows(spark, sf_dir).withColumn("vector", F.when(F.col("l_returnflag") != "R", F.col("id"))))


def file_changes(spark, sf_dir):
    """A stored state and a current one of the orders' files, classified."""
    own = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_path"), F.sha2(F.col("o_orderstatus"), 256).alias("file_hash"))
    stored = own.where("file_path % 10 <> 1")
    current = own.where("file_path % 10 <> 2").withColumn("file_hash", F.when(F.col("file_path") % 10 == 3, "changed").otherwise(F.col("file_hash")))
    return catalog.classify(stored, current, ["file_path"])


def upsert(spark, sf_dir):
    """Customers merged with changed and new rows; the name of a known one stays."""
    own = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    changed = own.where("c_custkey % 4 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("new").alias("c_name"), (F.col("c_nationkey") + 100).alias("c_nationkey"))
    return catalog.upsert(own, changed, ["c_custkey"], ["c_name"])


def insert_missing(spark, sf_dir):
    own = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return catalog.insert_missing(own, own.select((F.col("s_suppkey") * 3).alias("s_suppkey"), F.lit(-1).cast(own.schema["s_nationkey"].dataType).alias("s_nationkey")), ["s_suppkey"])


def removed_paths(spark, sf_dir):
    """Customers that have no order: the anti-join of a removal."""
    gone = _read(spark, sf_dir, "customer").select("c_custkey").join(_read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return gone


def cascade_delete(spark, sf_dir):
    """What is left of documents, chunks and vectors after the documents of every fifth knowledge base are gone."""
    docs, chunks, vectors = _documents(spark, sf_dir), _chunk_rows(spark, sf_dir), _vector_rows(spark, sf_dir)
    gone = docs.where("knowledge_base_id % 5 = 0").select(F.col("id").alias("document_id"))
    lost = chunks.join(gone, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    left = n(docs.join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti"), "documents")
    return left.crossJoin(n(chunks.join(gone, "document_id", "left_anti"), "chunks")).crossJoin(n(vectors.join(lost, "chunk_id", "left_anti"), "vectors"))


def case_evidence(spark, sf_dir):
    """Customers as required cases, orders as measured ones; every fifth customer is decided by a check."""
    customers = _read(spark, sf_dir, "customer")
    required = customers.select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") * 3).alias("measured_id"), F.col("c_name").alias("description"))
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAIL")
    measured = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), status.alias("status"), F.col("o_totalprice").alias("duration_ms"), F.col("o_orderpriority").alias("actual"))
    checks = customers.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 10 == 0).alias("passed"))
    return benchmarks.case_evidence(required, measured, checks)


def historical_comparison(spark, sf_dir):
    """The mean latency of two chunk configurations, of the first rounds and of the later ones."""
    own = _samples(spark, sf_dir).where("success").withColumn("top_k", F.lit(3))
    mean = lambda df: _rounded(df.groupBy("chunk_config", "top_k").agg(F.avg("latency_ms").alias("mean_ms"), F.count(F.lit(1)).alias("n")))
    rows = benchmarks.historical_comparison(mean(own.where("round < 2")), mean(own.where("round >= 2")), "c0", "c1")
    return rows.select(*(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in ("chunk_config", "top_k", "mean_ms", "n")), "strict_ab")


def storage_comparison(spark, sf_dir):
    """Orders as builds and events as searches of two backends at three scales."""
    scale = lambda key: [F.concat(F.lit("b"), F.col(key) % 2).alias("backend"), (F.col(key) % 3 * 1000).cast("long").alias("vector_count")]
    builds = _read(spark, sf_dir, "orders").select(*scale("o_custkey"), F.lit(64).alias("dimension"), F.col("o_totalprice").alias("insert_ms"), F.col("o_orderkey").alias("database_bytes"))
    searches = _samples(spark, sf_dir).select(*scale("user_id"), F.when(F.col("user_id") % 4 == 0, 3).otherwise(5).alias("top_k"), "latency_ms", "success")
    rows = benchmarks.storage_comparison(builds, searches)
    return rows.withColumns({c: F.round(c, 4) for c in ("build_ms_mean", "database_bytes_mean")})


def diagnostics(spark, sf_dir):
    """How many chunks each document and how many vectors each profile has."""
    docs, none = _documents(spark, sf_dir), spark.range(0)
    unused = none.select(*(F.lit("").alias(c) for c in ("id", "name", "root_path", "embedding_profile_id", "model_id", "dimension", "config_hash", "status")))
    found = views.diagnostics(unused, docs.withColumn("file_hash", F.lit("")), _chunk_rows(spark, sf_dir), _vector_rows(spark, sf_dir), unused, unused)
    parts = [df.select(F.lit(name).alias("what"), df[0].cast("string").alias("key"), df[1].alias("n")) for name, df in found.items() if name in ("chunks", "vectors")]
    return parts[0].unionByName(parts[1])


def service_documents(spark, sf_dir):
    """Orders as a service's documents, the fulfilled ones active."""
    own = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("deleted").alias("status"), F.col("o_orderdate").alias("created_at"))
    return views.service_documents(own).select("id", "created_at", "total")


def case_passes(spark, sf_dir):
    """Orders as cases, by the first character of their priority."""
    own = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("status"))
    return benchmarks.passes_by_prefix(own)


def chunk_report(spark, sf_dir):
    """Chunk configurations with their latency at each k, and the share of clicks and purchases as two modes' quality."""
    own = _samples(spark, sf_dir).withColumn("top_k", F.col("user_id") % 2 * 2 + 3)
    runs = own.groupBy("chunk_config").agg(F.count(F.lit(1)).alias("chunk_count"), F.max("event_id").alias("database_bytes_mean"))
    share = lambda mode, kind: own.groupBy("chunk_config", "top_k").agg(F.round(F.avg((F.col("event_type") == kind).cast("int")), 6).alias("recall")).withColumn("mode", F.lit(mode))
    rows = benchmarks.report_table(runs, latency_table(own, ["chunk_config", "top_k"]), share("vector", "click").unionByName(share("hybrid", "purchase")), "chunk_config")
    quality = [F.col(f"{m}_quality.recall").alias(f"{m}_recall") for m in ("vector", "hybrid")]
    return rows.select("chunk_config", "top_k", "chunk_count", "database_bytes_mean", "total_samples", "p50_ms", "p95_ms", *quality)


def hardware_estimates(spark, sf_dir):
    """Languages as models, their texts as cache, process and database."""
    own = _read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("model")).agg((F.sum("n_chars") * 20000).alias("cache_bytes"), (F.sum("n_chars") * 5000).alias("private_bytes"), (F.max("n_chars") * 100000).alias("database_bytes"))
    return _rounded(benchmarks.hardware_estimates(own))


def stable_ids(spark, sf_dir):
    own = _documents(spark, sf_dir)
    return own.select("id", catalog.stable_id(F.col("knowledge_base_id").cast("string"), F.col("id").cast("string")).alias("stable_id"))


_POINTS = f"""{_SAMPLES}, base AS (SELECT model AS profile, chunk_config, {_SUMMARY} FROM samples GROUP BY 1, 2),
raw AS (
  SELECT profile, chunk_config, max(p50_ms) OVER g - p50_ms AS a, max(p95_ms) OVER g - p95_ms AS b, 1000.0 / mean_ms AS c, count(*) OVER g AS n FROM base WINDOW g AS (PARTITION BY profile)
), scaled AS (
  SELECT profile, chunk_config, n, {', '.join(f"CASE WHEN max({x}) OVER g > min({x}) OVER g THEN ({x} - min({x}) OVER g) / (max({x}) OVER g - min({x}) OVER g) ELSE 0 END + 1e-12 AS {x}" for x in 'abc')}
  FROM raw WINDOW g AS (PARTITION BY profile)
), shares AS (SELECT *, {', '.join(f"{x} / sum({x}) OVER g AS p{x}" for x in 'abc')} FROM scaled WINDOW g AS (PARTITION BY profile)),
spread AS (SELECT *, {', '.join(f"1 + sum(p{x} * ln(p{x})) OVER g / ln(n) AS d{x}" for x in 'abc')} FROM shares WINDOW g AS (PARTITION BY profile)),
weighted AS (SELECT *, {', '.join(f"d{x} / (da + db + dc) AS w{x}" for x in 'abc')} FROM spread)"""
_QUALITY = "q AS (SELECT source, avg(quality) AS recall, avg(toxic) AS mrr, avg(n_chars % 10) AS ndcg FROM labels JOIN documents USING (doc_id) GROUP BY source)"

QUERIES = {
    "latency_by_model": (latency_by_model, f"WITH {_SAMPLES} SELECT model, chunk_config, {_SUMMARY}, CASE WHEN count_if(success) >= 1000 THEN round(quantile_cont(latency_ms, 0.99) FILTER (success), 6) END AS p99_ms FROM samples GROUP BY 1, 2"),
    "latency_grouping_sets": (latency_grouping_sets, f"WITH {_SAMPLES} SELECT model, round, {_SUMMARY}, round(quantile_cont(latency_ms, 0.99) FILTER (success), 6) AS p99_ms FROM samples GROUP BY GROUPING SETS ((model), (round), ())".replace("SELECT model, round,", "SELECT model, samples.round AS round,").replace("((model), (round), ())", "((model), (samples.round), ())")),
    "throughput": (throughput, f"WITH {_SAMPLES} SELECT model, s.round AS round, round(avg((s.round + 1) / (latency_ms / 1000.0)), 4) AS texts_per_second_mean, round(avg(length(event_type) / (latency_ms / 1000.0)), 4) AS tokens_per_second_mean, round(avg((s.round + 1) / (latency_ms / 1000.0)), 4) AS vectors_per_second_mean FROM samples s WHERE success AND latency_ms > 0 GROUP BY 1, 2"),
    "queries_per_second": (queries_per_second, f"WITH {_SAMPLES}, r AS (SELECT model, s.round, count_if(success) / (sum(latency_ms) / 1000.0) AS qps, sum(latency_ms) FILTER (success) AS ms, count_if(success) AS n FROM samples s GROUP BY 1, 2) SELECT model, round(avg(qps), 6) AS mean_qps, round(sum(n) * 1000.0 / sum(ms), 6) AS qps_sequential FROM r GROUP BY 1"),
    "cpu_usage": (cpu_usage, f"WITH {_RESOURCES} SELECT pid, sample_index, round(cpu_pct, 6) AS cpu_pct FROM cpu"),
    "resource_summary": (resource_summary, f"WITH {_RESOURCES}, s AS (SELECT profile, sample_index, sum(w) AS w, sum(p) AS p, sum(cpu_pct) AS c, count(cpu_pct) AS n, max(cpu_pct) AS m FROM cpu GROUP BY 1, 2) SELECT profile, CAST(max(w) AS BIGINT) AS peak_stack_working_set_bytes, CAST(max(p) AS BIGINT) AS peak_stack_private_bytes, round(sum(c) / sum(n), 6) AS mean_process_cpu_pct, round(max(m), 6) AS peak_process_cpu_pct FROM s GROUP BY 1"),
    "entropy_weights": (entropy_weights, f"WITH {_POINTS} SELECT profile, chunk_config, round(wa, 5) AS w_p50_cost, round(wb, 5) AS w_p95_cost, round(wc, 5) AS w_qps, round((wa * a + wb * b + wc * c) * 100, 5) AS entropy_score FROM weighted"),
    "quality_scores": (quality_scores, f"WITH {_QUALITY} SELECT source, round(({' + '.join(f'CASE WHEN max({x}) OVER () > min({x}) OVER () THEN ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) ELSE 0 END' for x in ('recall', 'mrr', 'ndcg'))}) * 100.0 / 3, 6) AS quality_score FROM q"),
    "memory_estimate": (memory_estimate, "SELECT source, CAST(coalesce(list_filter([8, 16, 32, 64, 128], lambda x: x >= need)[1], pow(2, ceil(log2(need)))) AS BIGINT) AS gib FROM (SELECT source, 4 + 1.5 * (sum(n_chars) * 150000) / 1073741824.0 AS need FROM documents GROUP BY source)"),
    "recommended_chunking": (recommended_chunking, f"WITH {_QUALITY} SELECT source AS recommended FROM q ORDER BY ndcg DESC, source LIMIT 1"),
    "model_ratios": (model_ratios, f"WITH {_SAMPLES}, b AS (SELECT chunk_config, model, round(avg(latency_ms) FILTER (success), 6) AS mean_ms FROM samples GROUP BY 1, 2) SELECT b.chunk_config, b.model, b.mean_ms, round(b.mean_ms / o.mean_ms, 6) AS ratio FROM b JOIN b o ON o.chunk_config = b.chunk_config AND o.model = 'm0'"),
    "model_comparison": (model_comparison, f"WITH {_SAMPLES} SELECT chunk_config, {', '.join(f'''round(quantile_cont(latency_ms, 0.5) FILTER (success AND model = '{m}'), 6) AS {m}''' for m in ('m0', 'm1', 'm2'))} FROM samples GROUP BY 1"),
    "result_overlap": (result_overlap, "WITH a AS (SELECT user_id, list(event_id ORDER BY value DESC, event_id)[1:5] AS ids FROM events GROUP BY 1), b AS (SELECT user_id, list(event_id ORDER BY event_id DESC)[1:5] AS others FROM events GROUP BY 1) SELECT user_id % 4 AS band, round(avg(len(list_intersect(ids, others)) / 5.0), 6) AS mean_overlap, round(avg(CAST(ids = others AS INTEGER)), 6) AS exact_match_rate FROM a JOIN b USING (user_id) GROUP BY 1"),
    "hardware_matrix": (hardware_matrix, "SELECT r_name AS profile, model, chunk_config, 'fixed' AS strategy, top_k FROM region, (SELECT DISTINCT lang AS model FROM documents), (SELECT DISTINCT l_returnflag || l_linestatus AS chunk_config FROM lineitem WHERE l_returnflag < 'R'), (SELECT unnest([3, 5, 10]) AS top_k)"),
    "request_sequence": (request_sequence, "SELECT item_id AS query_id, CAST(r AS INTEGER) AS repetition, sha256('20260907:' || item_id || ':' || r) AS place FROM benchmark, (SELECT count(*) AS n FROM benchmark) c, unnest(range(1, CAST(greatest(1, ceil(334.0 / n)) AS BIGINT) + 1)) t(r)"),
    "sample_count_errors": (sample_count_errors, "SELECT DISTINCT user_id AS run_id, 'total_samples' AS field FROM events WHERE user_id % 9 = 0"),
    "successful_summary": (successful_summary, f"WITH {_SAMPLES} SELECT model, count(*) AS query_count, round(avg(CAST(event_id % 3 = 0 AS INTEGER)), 6) AS hit_rate, round(avg(1.0 / (event_id % 4 + 1)), 6) AS mrr, round(avg(latency_ms), 6) AS mean_latency_ms FROM samples WHERE success GROUP BY 1"),
    "first_seen": (first_seen, "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    "latency_windows": (latency_windows, "SELECT time_bucket(INTERVAL 1 hour, CAST(ts AS TIMESTAMP)) AS start, count(*) AS samples, count_if(event_type <> 'error') AS succeeded, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_ms, round(max(value) FILTER (event_type <> 'error'), 6) AS max_ms FROM events GROUP BY 1"),
    "document_listing": (document_listing, f"WITH {_CATALOG} SELECT d.id, d.knowledge_base_id, d.file_name, d.status, count(DISTINCT c.id) AS chunk_count, count(DISTINCT v.chunk_id) AS vector_count FROM documents_ d LEFT JOIN chunks_ c ON c.document_id = d.id LEFT JOIN vectors_ v ON v.chunk_id = c.id GROUP BY ALL"),
    "chunk_listing": (chunk_listing, f"WITH {_CATALOG} SELECT c.id, document_id, file_name, chunk_index, text FROM chunks_ c JOIN documents_ d ON d.id = c.document_id"),
    "covered_documents": (covered_documents, f"WITH {_CATALOG} SELECT id AS document_id FROM documents_ d WHERE EXISTS (SELECT 1 FROM chunks_ c WHERE c.document_id = d.id) AND NOT EXISTS (SELECT 1 FROM chunks_ c WHERE c.document_id = d.id AND NOT EXISTS (SELECT 1 FROM vectors_ v WHERE v.chunk_id = c.id))"),
    "profile_listing": (profile_listing, f"WITH {_CATALOG} SELECT embedding_profile_id AS id, 'kb' AS knowledge_base_id, CASE WHEN embedding_profile_id < 'N' THEN 'INDEXED' ELSE 'EMPTY' END AS status, count(*) AS vector_count FROM vectors_ GROUP BY 1"),
    "dashboard": (dashboard, f"WITH {_CATALOG} SELECT (SELECT count(*) FROM customer) AS knowledge_bases, (SELECT count(*) FROM documents_) AS documents, (SELECT count(*) FROM chunks_) AS chunks, (SELECT count(*) FROM vectors_) AS vectors, 'MOCK_ONLY' AS embedding_status, (SELECT o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS index_status"),
    "searchable_chunks": (
        searchable_chunks,
        f"WITH {_CATALOG} SELECT id, document_id, chunk_index, text FROM chunks_ c WHERE id IN (SELECT chunk_id FROM vectors_) AND document_id IN (SELECT id FROM documents_ WHERE status = 'O')",
    ),
    "service_statistics": (service_statistics, f"WITH {_CATALOG} SELECT (SELECT count_if(status = 'O') FROM documents_) AS active_documents, count(*) AS chunks, count_if(l_returnflag <> 'R') AS vectors FROM chunks_"),
    "file_changes": (file_changes, "WITH s AS (SELECT o_orderkey AS k, sha256(o_orderstatus) AS h FROM orders WHERE o_orderkey % 10 <> 1), c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 3 THEN 'changed' ELSE sha256(o_orderstatus) END AS h FROM orders WHERE o_orderkey % 10 <> 2) SELECT coalesce(s.k, c.k) AS file_path, CASE WHEN s.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' WHEN s.h = c.h THEN 'unchanged' ELSE 'updated' END AS change FROM s FULL JOIN c ON s.k = c.k"),
    "upsert": (upsert, "WITH n AS (SELECT c_custkey * 2 AS c_custkey, 'new' AS c_name, c_nationkey + 100 AS c_nationkey FROM customer WHERE c_custkey % 4 = 0) SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(o.c_name, n.c_name) AS c_name, coalesce(n.c_nationkey, o.c_nationkey) AS c_nationkey FROM customer o FULL JOIN n ON n.c_custkey = o.c_custkey"),
    "insert_missing": (insert_missing, "SELECT s_suppkey, s_nationkey FROM supplier UNION ALL SELECT s_suppkey * 3, -1 FROM supplier WHERE s_suppkey * 3 NOT IN (SELECT s_suppkey FROM supplier)"),
    "removed_paths": (removed_paths, "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "cascade_delete": (cascade_delete, f"WITH {_CATALOG}, kept AS (SELECT id FROM documents_ WHERE knowledge_base_id % 5 <> 0) SELECT (SELECT count(*) FROM kept) AS documents, (SELECT count(*) FROM chunks_ WHERE document_id IN (SELECT id FROM kept)) AS chunks, (SELECT count(*) FROM vectors_ WHERE chunk_id // 10 IN (SELECT id FROM kept)) AS vectors"),
    "case_evidence": (case_evidence, "SELECT c_custkey AS case_id, c_name AS description, CASE WHEN o_orderkey IS NOT NULL AND CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 10 = 0 ELSE o_orderstatus <> 'O' END THEN 'PASS' ELSE 'FAIL' END AS status, o_totalprice AS duration_ms, o_orderpriority AS actual FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 3"),
    "historical_comparison": (historical_comparison, f"WITH {_SAMPLES}, m AS (SELECT s.round < 2 AS former, chunk_config, 3 AS top_k, round(avg(latency_ms), 6) AS mean_ms, count(*) AS n FROM samples s WHERE success GROUP BY 1, 2) SELECT o.chunk_config AS old_chunk_config, o.top_k AS old_top_k, o.mean_ms AS old_mean_ms, o.n AS old_n, w.chunk_config AS new_chunk_config, w.top_k AS new_top_k, w.mean_ms AS new_mean_ms, w.n AS new_n, false AS strict_ab FROM m o, m w WHERE o.former AND o.chunk_config = 'c0' AND NOT w.former AND w.chunk_config = 'c1'"),
    "storage_comparison": (storage_comparison, f"WITH b AS (SELECT 'b' || (o_custkey % 2) AS backend, o_custkey % 3 * 1000 AS vector_count, 64 AS dimension, round(avg(o_totalprice), 4) AS build_ms_mean, round(avg(o_orderkey), 4) AS database_bytes_mean FROM orders GROUP BY ALL), {_SAMPLES}, s AS (SELECT 'b' || (user_id % 2) AS backend, CAST(user_id % 3 * 1000 AS BIGINT) AS vector_count, CASE WHEN user_id % 4 = 0 THEN 3 ELSE 5 END AS top_k, {_SUMMARY}, CASE WHEN count_if(success) >= 1000 THEN round(quantile_cont(latency_ms, 0.99) FILTER (success), 6) END AS p99_ms FROM samples GROUP BY 1, 2, 3) SELECT s.*, dimension, build_ms_mean, database_bytes_mean FROM s LEFT JOIN b USING (backend, vector_count)"),
    "diagnostics": (diagnostics, f"WITH {_CATALOG} SELECT 'chunks' AS what, CAST(document_id AS VARCHAR) AS key, count(*) AS n FROM chunks_ GROUP BY 2 UNION ALL SELECT 'vectors', embedding_profile_id, count(*) FROM vectors_ GROUP BY 2"),
    "service_documents": (service_documents, "SELECT o_orderkey AS id, o_orderdate AS created_at, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F'"),
    "case_passes": (case_passes, "SELECT substr(o_orderpriority, 1, 1) AS prefix, count_if(o_orderstatus = 'F') AS passed, count(*) AS cases FROM orders GROUP BY 1"),
    "chunk_report": (chunk_report, f"WITH {_SAMPLES}, own AS (SELECT *, user_id % 2 * 2 + 3 AS top_k FROM samples), runs AS (SELECT chunk_config, count(*) AS chunk_count, max(event_id) AS database_bytes_mean FROM own GROUP BY 1), each AS (SELECT chunk_config, top_k, count(*) AS total_samples, round(quantile_cont(latency_ms, 0.5) FILTER (success), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95) FILTER (success), 6) AS p95_ms, round(avg(CAST(event_type = 'click' AS INTEGER)), 6) AS vector_recall, round(avg(CAST(event_type = 'purchase' AS INTEGER)), 6) AS hybrid_recall FROM own GROUP BY 1, 2) SELECT chunk_config, top_k, chunk_count, database_bytes_mean, total_samples, p50_ms, p95_ms, vector_recall, hybrid_recall FROM runs LEFT JOIN each USING (chunk_config)"),
    "hardware_estimates": (hardware_estimates, "WITH m AS (SELECT lang AS model, CAST(sum(n_chars) * 25000 AS BIGINT) AS basis, 4 + 1.5 * (sum(n_chars) * 25000) / 1073741824.0 AS ram, greatest(1.0, 1.5 * (sum(n_chars) * 20000 + max(n_chars) * 100000) / 1073741824.0) AS disk FROM documents GROUP BY 1) SELECT model, basis AS memory_basis_bytes, round(ram, 6) AS formula_required_gib, CAST(coalesce(list_filter([8, 16, 32, 64, 128], lambda x: x >= ram)[1], pow(2, ceil(log2(ram)))) AS BIGINT) AS minimum_standard_ram_gib, CAST(coalesce(list_filter([1, 2, 4, 8, 16], lambda x: x >= disk)[1], pow(2, ceil(log2(disk)))) AS BIGINT) AS minimum_free_disk_gib FROM m"),
    "stable_ids": (stable_ids, f"WITH {_CATALOG}, h AS (SELECT id, sha256(knowledge_base_id || chr(31) || id) AS h FROM documents_) SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS stable_id FROM h"),
}
