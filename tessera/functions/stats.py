"""Aggregate and window expressions of the evaluation: latency, quality, resources, scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MEMORY_SIZES = (8, 16, 32, 64, 128)
DISK_SIZES = (1, 2, 4, 8, 16)
P99_LEAST = 1000


def linear_percentile(value: Column, fraction: float) -> Column:
    """Percentile with linear interpolation; null for no values. A group's distinct values meet in one task, so it is for
    groups of bounded size; ``operators.latency`` has the others."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be between 0 and 1")
    return F.percentile(value, F.lit(fraction))


def latency_summary(latency: str = "latency_ms", success: str = "success", always_p99: bool = False) -> list[Column]:
    """Aggregates over samples: counts, and of the successful ones mean, min, max, p50, p95 and p99, to 6 digits.

    p99 needs P99_LEAST successes unless ``always_p99``. For groups of bounded size, see ``linear_percentile``.
    """
    good = F.coalesce(F.col(success), F.lit(False)) & F.col(latency).isNotNull()
    value, n = F.when(good, F.col(latency)), F.count_if(good)
    p99 = linear_percentile(value, 0.99)
    named = {
        "mean_ms": F.avg(value),
        "min_ms": F.min(value),
        "max_ms": F.max(value),
        "p50_ms": linear_percentile(value, 0.5),
        "p95_ms": linear_percentile(value, 0.95),
        "p99_ms": p99 if always_p99 else F.when(n >= P99_LEAST, p99),
    }
    counts = [F.count(F.lit(1)).alias("total_samples"), n.alias("successful_samples"), F.count_if(~good).alias("failed_samples")]
    return counts + [F.round(c, 6).alias(k) for k, c in named.items()]


def cpu_percent(samples: DataFrame, cpus: int, interval_ms: int) -> DataFrame:
    """``samples`` (pid, sample_index, cpu_seconds) with cpu_pct since the process's sample before."""
    order = W.partitionBy("pid").orderBy("sample_index")
    steps = F.col("sample_index") - F.lag("sample_index").over(order)
    used = F.col("cpu_seconds") - F.lag("cpu_seconds").over(order)
    share = used / (steps * (interval_ms / 1000.0) * max(cpus, 1)) * 100.0
    return samples.withColumn("cpu_pct", F.when(steps > 0, F.greatest(F.lit(0.0), share)))


def resource_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """Peaks of the memory summed up over the processes of a sample, mean and peak of cpu_pct."""
    per_sample = samples.groupBy(*by, "sample_index").agg(
        F.sum("working_set_bytes").alias("w"), F.sum("private_bytes").alias("p"), F.sum("cpu_pct").alias("c"), F.count("cpu_pct").alias("n"), F.max("cpu_pct").alias("m")
    )
    return per_sample.groupBy(*by).agg(
        F.max("w").alias("peak_stack_working_set_bytes"),
        F.max("p").alias("peak_stack_private_bytes"),
        (F.sum("c") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_process_cpu_pct"),
        F.max("m").alias("peak_process_cpu_pct"),
    )


def min_max(value: Column, window) -> Column:
    """Position between the window's least and greatest value; 0 if these are equal."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high > low, (value - low) / (high - low)).otherwise(0.0)


def entropy_scores(points: DataFrame, by: list[str]) -> DataFrame:
    """``points`` (p50_ms, p95_ms, qps_sequential) with entropy weights of the three fields and the weighted score.

    Weights are worked out inside each group of ``by``; a group of one point is an error (ln 1 divides).
    """
    group = W.partitionBy(*by)
    cost = lambda c: F.max(c).over(group) - F.col(c)
    n = F.count(F.lit(1)).over(group)
    fields = ("p50_cost", "p95_cost", "qps")
    raw = points.withColumns({"p50_cost": cost("p50_ms"), "p95_cost": cost("p95_ms"), "qps": F.col("qps_sequential").cast("double"), "_n": n})
    scaled = raw.withColumns({f"_{f}": min_max(F.col(f), group) + 1e-12 for f in fields})
    shares = scaled.withColumns({f"_p_{f}": F.col(f"_{f}") / F.sum(f"_{f}").over(group) for f in fields})
    size = F.when(F.col("_n") > 1, F.ln("_n")).otherwise(F.raise_error("entropy weights need two points or more").cast("double"))
    spread = shares.withColumns({f"_d_{f}": 1.0 + F.sum(F.col(f"_p_{f}") * F.ln(f"_p_{f}")).over(group) / size for f in fields})
    total = sum((F.col(f"_d_{f}") for f in fields[1:]), F.col(f"_d_{fields[0]}"))
    weights = spread.withColumns({f"w_{f}": F.col(f"_d_{f}") / F.when(total == 0, 1.0).otherwise(total) for f in fields})
    score = sum((F.col(f"w_{f}") * F.col(f"_{f}") for f in fields[1:]), F.col(f"w_{fields[0]}") * F.col(f"_{fields[0]}"))
    kept = [*points.columns, *(f"w_{f}" for f in fields)]
    return weights.select(*kept, (score * 100.0).alias("entropy_score"))


def quality_score(points: DataFrame, fields: tuple[str, ...] = ("recall", "mrr", "ndcg"), by: list[str] | None = None) -> DataFrame:
    """``points`` with the mean of its fields' positions between least and greatest, times 100, in each group or over all.

    The bounds come from one aggregate, a row a group, so no group is sorted in one task.
    """
    bounds = points.groupBy(*(by or [])).agg(*(f(c).alias(f"_{f.__name__}_{c}") for c in fields for f in (F.min, F.max)))
    low, high = (lambda c: F.col(f"_min_{c}")), (lambda c: F.col(f"_max_{c}"))
    place = [F.when(high(c) > low(c), (F.col(c) - low(c)) / (high(c) - low(c))).otherwise(0.0) for c in fields]
    if by:
        same = [F.col(f"_by{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
        rows = points.join(bounds.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)}), same)
    else:
        rows = points.crossJoin(F.broadcast(bounds))  # one row
    return rows.select(*points.columns, (sum(place[1:], place[0]) * 100.0 / len(fields)).alias("quality_score"))


def next_capacity(need: Column, sizes: tuple[int, ...]) -> Column:
    """The least of the usual sizes that is enough; beyond these the next power of two."""
    fits = F.filter(F.array(*map(F.lit, sizes)), lambda x: x >= need)
    return F.coalesce(F.get(fits, F.lit(0)).cast("long"), F.pow(F.lit(2.0), F.ceil(F.log2(need))).cast("long"))


def memory_needed_gib(peak_bytes: Column) -> Column:
    """The least usual memory size of 4 GiB plus one and a half times the peak."""
    return next_capacity(4 + 1.5 * peak_bytes / 1024.0**3, MEMORY_SIZES)


def disk_needed_gib(stored_bytes: Column) -> Column:
    """The least usual disk size of one and a half times what is stored, and of 1 GiB."""
    return next_capacity(F.greatest(F.lit(1.0), 1.5 * stored_bytes / 1024.0**3), DISK_SIZES)
