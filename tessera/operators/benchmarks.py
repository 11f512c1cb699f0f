"""Benchmark analytics: throughput, storage comparison, hardware matrix, fixtures, and checks of run documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stats import disk_needed_gib, memory_needed_gib
from tessera.operators.latency import latency_table

REQUIRED_SECTIONS = (
    "run_info test_config dataset environment latency_samples resource_samples quality_details case_results summary artifacts errors notes"
).split()
MOST_VECTORS, MOST_DIMENSIONS = 10_000, 4096


def throughput(samples: DataFrame, by: list[str]) -> DataFrame:
    """Means of texts, tokens and vectors per second over ``samples`` (latency_ms, text_count, token_count, vector_count)."""
    rate = lambda c: F.avg(F.col(c) / (F.col("latency_ms") / 1000.0))
    return samples.where("latency_ms > 0").groupBy(*by).agg(
        rate("text_count").alias("texts_per_second_mean"), rate("token_count").alias("tokens_per_second_mean"), rate("vector_count").alias("vectors_per_second_mean")
    )


def queries_per_second(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean over rounds of successes per second of a round's summed latency; and 1000 / mean latency."""
    good = F.coalesce(F.col("success"), F.lit(False))
    rounds = samples.groupBy(*by, "round").agg(
        (F.count_if(good) / (F.sum("latency_ms") / 1000.0)).alias("qps"), F.sum(F.when(good, F.col("latency_ms"))).alias("ms"), F.count_if(good).alias("n")
    )
    return rounds.groupBy(*by).agg(F.avg("qps").alias("mean_qps"), (F.sum("n") * 1000.0 / F.sum("ms")).alias("qps_sequential"))


def result_overlap(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], k: int) -> DataFrame:
    """Mean share of common ids and share of equal lists of two result tables (keys, ids); a missing list is empty."""
    rows = left.join(right.withColumnRenamed("ids", "others"), keys, "left").withColumn("others", F.coalesce("others", F.array().cast(left.schema["ids"].dataType)))
    common = F.size(F.array_intersect("ids", "others")) / float(k)
    return rows.groupBy(*by).agg(F.avg(common).alias("mean_overlap"), F.avg((F.col("ids") == F.col("others")).cast("int")).alias("exact_match_rate"))


def hardware_matrix(profiles: DataFrame, models: DataFrame, chunk_configs: DataFrame, top_k: DataFrame) -> DataFrame:
    """Every combination of profile, model, fixed chunk configuration and k; each input has a handful of rows."""
    fixed = chunk_configs.where("strategy = 'fixed'")
    return profiles.crossJoin(models).crossJoin(fixed).crossJoin(top_k)


def recommended_fixed(rows: DataFrame, k: int = 3) -> DataFrame:
    """The fixed chunk configuration of the highest nDCG at ``k``; of equal ones the first by name. No such row: error."""
    own = rows.where((F.col("strategy") == "fixed") & (F.col("top_k") == k))
    best = own.agg(F.min(F.struct((-F.col("ndcg")).alias("n"), "chunk_config"))["chunk_config"].alias("recommended"))
    return best.select(F.coalesce("recommended", F.raise_error("no fixed chunk configuration")).alias("recommended"))


def ratios(rows: DataFrame, by: list[str], value: str, model: str, baseline: str) -> DataFrame:
    """Each model's value over the baseline model's in the same group."""
    base = rows.where(F.col(model) == baseline).select(*by, F.col(value).alias("_base"))
    return rows.join(base, by).withColumn("ratio", F.col(value) / F.nullif("_base", F.lit(0.0))).drop("_base")


def synthetic_vectors(spark: SparkSession, n: int, dimension: int) -> DataFrame:
    """id ``c0``.., vector ((i+1)(j+3) mod 97)/97; n and dimension are clamped to 1..10000 and 1..4096."""
    n, dimension = min(max(n, 1), MOST_VECTORS), min(max(dimension, 1), MOST_DIMENSIONS)
    value = lambda j: (((F.col("i") + 1) * (j + 3)) % 97 / 97.0).cast("float")
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value)
    return spark.range(n).withColumnRenamed("id", "i").select(F.concat(F.lit("c"), "i").alias("id"), vector.alias("vector"))


def request_sequence(queries: DataFrame, least: int, seed: int) -> DataFrame:
    """The queries repeated to at least ``least`` requests, in an order drawn by ``seed``; the same in each run."""
    n = queries.agg(F.count(F.lit(1)).alias("n"))
    times = F.greatest(F.lit(1), F.ceil(least / F.col("n"))).cast("int")
    each = queries.crossJoin(F.broadcast(n)).withColumn("repetition", F.explode(F.sequence(F.lit(1), times))).drop("n")  # n is one row
    return each.withColumn("place", F.sha2(F.concat_ws(":", F.lit(str(seed)), "query_id", "repetition"), 256))


def run_errors(run: dict) -> list[str]:
    """What is wrong with a run document: missing sections, no run id, counts that don't match the samples."""
    missing = [f"missing section: {s}" for s in REQUIRED_SECTIONS if s not in run]
    if missing:
        return missing
    run_id, samples, errors = run["run_info"].get("run_id"), run["latency_samples"], []
    if not isinstance(run_id, str) or not run_id.strip():
        errors.append("run_info.run_id must be a non-empty string")
    if not isinstance(samples, list):
        return [*errors, "latency_samples must be a list"]
    good = sum(s.get("success") is True and s.get("latency_ms") is not None for s in samples)
    counts = {"total_samples": len(samples), "successful_samples": good, "failed_samples": len(samples) - good}
    return errors + [f"summary.{k} does not match latency_samples" for k, v in counts.items() if run["summary"].get(k) != v]


def sample_count_errors(runs: DataFrame, samples: DataFrame) -> DataFrame:
    """run_id, field: counts of ``runs`` (run_id, total_samples, ..) that differ from ``samples`` (run_id, success, latency_ms)."""
    good = F.coalesce(F.col("success"), F.lit(False)) & F.col("latency_ms").isNotNull()
    actual = samples.groupBy("run_id").agg(F.count(F.lit(1)).alias("t"), F.count_if(good).alias("s"), F.count_if(~good).alias("f"))
    rows = runs.join(actual, "run_id", "left")
    fields = {"total_samples": "t", "successful_samples": "s", "failed_samples": "f"}
    bad = F.array_compact(F.array(*[F.when(F.col(k) != F.coalesce(v, F.lit(0)), F.lit(k)) for k, v in fields.items()]))
    return rows.select("run_id", F.explode(bad).alias("field"))


def session_check(session_status: str, runs: DataFrame) -> DataFrame:
    """One row: valid, n_runs, bad_runs of ``runs`` (run_id, status)."""
    bad = F.sort_array(F.collect_list(F.when(~F.col("status").isin("COMPLETE", "COMPLETE_WITH_ERRORS"), F.col("run_id"))))  # failed runs of one session
    rows = runs.agg(F.count(F.lit(1)).alias("n_runs"), bad.alias("bad_runs"))
    return rows.select(((F.size("bad_runs") == 0) & F.lit(session_status == "PASS")).alias("valid"), "n_runs", "bad_runs")


def case_evidence(required: DataFrame, measured: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """case_id, description, status, duration_ms, actual of the ``required`` cases (case_id, measured_id, description).

    ``measured`` is (case_id, status, duration_ms, actual); several cases may cite one measured. ``checks`` (case_id,
    passed) decide where there is one, else the measured status: PASS, also for null. A case without a measurement fails.
    """
    own = measured.select(F.col("case_id").alias("measured_id"), F.col("status").alias("_status"), "duration_ms", "actual", F.lit(True).alias("_there"))
    rows = required.join(own, "measured_id", "left")
    if checks is not None:
        rows = rows.join(checks.select("case_id", "passed"), "case_id", "left")
    passed = F.coalesce(*([F.col("passed")] if checks is not None else []), F.coalesce("_status", F.lit("PASS")) == "PASS")
    status = F.when(F.coalesce("_there", F.lit(False)) & passed, "PASS").otherwise("FAIL")
    return rows.select("case_id", "description", status.alias("status"), "duration_ms", "actual")


def case_summary(cases: DataFrame, required_count: int) -> DataFrame:
    """One row: pass_count, required_count, all_passed."""
    rows = cases.agg(F.count_if(F.col("status") == "PASS").alias("pass_count"))
    return rows.select("pass_count", F.lit(required_count).alias("required_count"), (F.col("pass_count") == required_count).alias("all_passed"))


def passes_by_prefix(cases: DataFrame) -> DataFrame:
    """prefix, passed, cases: the cases (case_id, status) by the first character of their ids."""
    return cases.groupBy(F.substring("case_id", 1, 1).alias("prefix")).agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count(F.lit(1)).alias("cases"))


def historical_comparison(former: DataFrame, current: DataFrame, former_config: str, current_config: str, top_k: int = 3) -> DataFrame:
    """old, new (structs of the rows' columns) and strict_ab, which is false as the runs weren't made side by side.

    One row of each side is compared, that of its chunk_config and ``top_k``; no row if either isn't there.
    """
    sides = []
    for df, config, name in ((former, former_config, "old"), (current, current_config, "new")):
        mine = df.where((F.col("chunk_config") == config) & (F.col("top_k") == top_k))
        sides.append(mine.orderBy(*(c for c, t in df.dtypes if not t.startswith("map"))).limit(1).select(F.struct("*").alias(name)))
    return sides[0].crossJoin(sides[1]).withColumn("strict_ab", F.lit(False))  # single rows


def storage_comparison(builds: DataFrame, searches: DataFrame) -> DataFrame:
    """backend, vector_count, dimension, top_k with the builds' means and the searches' latencies.

    ``builds`` is (backend, vector_count, dimension, insert_ms, database_bytes), a row a round; ``searches`` is
    (backend, vector_count, top_k, latency_ms, success), a row a query. Scales without a build keep nulls.
    """
    built = builds.groupBy("backend", "vector_count", "dimension").agg(F.avg("insert_ms").alias("build_ms_mean"), F.avg("database_bytes").alias("database_bytes_mean"))
    measured = latency_table(searches, ["backend", "vector_count", "top_k"])
    return measured.join(built, ["backend", "vector_count"], "left")


def report_table(runs: DataFrame, latency: DataFrame, quality: DataFrame, key: str, modes: tuple[str, ...] = ("vector", "hybrid")) -> DataFrame:
    """A row per run and top_k: the columns of ``runs`` (key, ...), its latency and, under each mode's name, its quality.

    ``latency`` is (key, top_k, ...), ``quality`` (key, mode, top_k, ...); a run without either keeps nulls.
    """
    metrics = [c for c in quality.columns if c not in (key, "mode", "top_k")]
    per_mode = quality.groupBy(key, "top_k").agg(*(F.max(F.when(F.col("mode") == m, F.struct(*metrics))).alias(f"{m}_quality") for m in modes))
    measured = latency.join(per_mode, [key, "top_k"], "full")
    return runs.join(measured, key, "left")


def hardware_estimates(models: DataFrame) -> DataFrame:
    """What ``models`` (model, cache_bytes, private_bytes, database_bytes) need: memory for cache and process, disk for cache and database."""
    basis = F.col("cache_bytes") + F.coalesce("private_bytes", F.lit(0))
    return models.select(
        "model", basis.alias("memory_basis_bytes"), (4 + 1.5 * basis / 1024.0**3).alias("formula_required_gib"),
        memory_needed_gib(basis).alias("minimum_standard_ram_gib"), disk_needed_gib(F.col("cache_bytes") + F.col("database_bytes")).alias("minimum_free_disk_gib"),
    )


@dataclass(frozen=True)
class RunConfig:
    """One retrieval run, checked."""

    model: str
    chunk_size: int
    overlap: int
    top_k: int
    rounds: int = 3
    strategy: str = "fixed"

    def __post_init__(self):
        if self.strategy not in ("fixed", "structure") or self.chunk_size <= 0 or self.top_k <= 0 or self.rounds <= 0:
            raise ValueError("strategy, chunk_size, top_k and rounds have to be valid and positive")
        if not 0 <= self.overlap < self.chunk_size:
            raise ValueError("overlap has to be in [0, chunk_size)")
