"""Exact percentiles of groups of any size by counting, and the latency summaries made of them.

A percentile needs one or two values at known ranks. A pass counts each group's values in RANGES equal ranges between
its least and greatest one; only the ranges that hold a wanted rank stay, and are counted again between their own least
and greatest value, until they hold one value or at most FEW rows, which are then sorted. Tasks sum up before anything
is shuffled, so what meets in one task is RANGES counts or FEW values, however many samples a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.stats import P99_LEAST
from tessera.sources.tables import written

RANGES = 4096
FEW = 10_000
#: So many ranges go to all tasks; beyond that samples and ranges meet in a join, dealt over SALTS parts.
BROADCAST_ROWS = 50_000
SALTS = 16


def _group(by: list[str]) -> Column:
    return F.struct(F.lit(0).alias("all"), *by).alias("g")


def _inside(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """g, low, high, v of the ``values`` (g, v) that lie in one of the ``ranges`` (g, low, high) of their group."""
    fits = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    named = ranges.withColumnRenamed("g", "rg")
    if ranges.count() <= BROADCAST_ROWS:
        met = values.join(F.broadcast(named), values["g"].eqNullSafe(named["rg"]) & fits)
    else:
        dealt = values.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        spread = named.withColumn("rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = dealt.join(spread, F.col("g").eqNullSafe(F.col("rg")) & (F.col("salt") == F.col("rsalt")) & fits)
    return met.select("g", "low", "high", "v")


def values_at(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, rank, value of the ``wanted`` (g, rank, low, high, n) in ``values`` (g, v): the value at ``rank``, counted from 0.

    ``low``, ``high`` and ``n`` are a group's least and greatest value and its number of values, which are finite.
    """
    found = []
    level = written(wanted.withColumn("at", F.col("rank")), "ranks")
    while True:
        found.append(level.where("low = high").select("g", "rank", F.col("low").alias("value")))
        few = level.where(f"low < high AND n <= {FEW}")
        if not few.isEmpty():
            rows = _inside(values, few.select("g", "low", "high").distinct())
            lists = rows.groupBy("g", "low").agg(F.sort_array(F.collect_list("v")).alias("sorted"))  # FEW at most
            found.append(_with_range(few, lists).select("g", "rank", F.get("sorted", F.col("at").cast("int")).alias("value")))
        rest = level.where(f"low < high AND n > {FEW}")
        if rest.isEmpty():
            break
        rows = _inside(values, rest.select("g", "low", "high").distinct())
        # Half of each, for their difference may be greater than the greatest double.
        place = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANGES)
        counts = rows.groupBy("g", "low", F.least(place, F.lit(RANGES - 1)).alias("place")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        up_to = F.sum("m").over(W.partitionBy("g", "low").orderBy("place"))
        ranges = counts.withColumn("before", up_to - F.col("m"))
        holding = _with_range(rest, ranges).where("before <= at AND at < before + m")
        level = written(holding.select("g", "rank", F.col("least").alias("low"), F.col("most").alias("high"), F.col("m").alias("n"), (F.col("at") - F.col("before")).alias("at")), "ranks")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _with_range(ranks: DataFrame, ranges: DataFrame) -> DataFrame:
    other = ranges.withColumnsRenamed({"g": "rg", "low": "rlow"})
    return ranks.join(other, F.col("g").eqNullSafe(F.col("rg")) & (F.col("low") == F.col("rlow")))


def exact_percentiles(samples: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    """``by`` and a column p0, p1, ... for each fraction: percentiles with linear interpolation, over all values without ``by``.

    Values that are null or not finite don't count; a group without others has no row. Null is a group like any other.
    """
    if not all(0 <= f <= 1 for f in fractions):
        raise ValueError("fraction must be between 0 and 1")
    v = F.col(value).cast("double")
    values = samples.select(_group(by), v.alias("v")).where(F.abs("v") < float("inf"))
    sizes = written(values.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")), "sizes")
    return _interpolated(values, sizes, by, fractions)


def _interpolated(values: DataFrame, sizes: DataFrame, by: list[str], fractions: list[float]) -> DataFrame:
    spot = lambda f: F.lit(float(f)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(spot(f)), F.ceil(spot(f))) for f in fractions))))
    found = values_at(values, sizes.select("g", F.explode(ranks).alias("rank"), "low", "high", "n"))
    known = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two a fraction
    both = sizes.select(F.col("g").alias("sg"), "n").join(known, F.col("sg").eqNullSafe(F.col("g")))
    below, above = (lambda f: F.col("at")[F.floor(spot(f))]), (lambda f: F.col("at")[F.ceil(spot(f))])
    return both.select(*(F.col("g")[c].alias(c) for c in by), *((below(f) + (above(f) - below(f)) * (spot(f) - F.floor(spot(f)))).alias(f"p{i}") for i, f in enumerate(fractions)))


def latency_table(samples: DataFrame, by: list[str], latency: str = "latency_ms", success: str = "success", always_p99: bool = False, sets: list[list[str]] | None = None) -> DataFrame:
    """Per group: counts, and of the successful samples mean, min, max, p50, p95 and p99, to 6 digits.

    p99 needs P99_LEAST successes unless ``always_p99``. ``sets`` are grouping sets of ``by``, all in the same passes.
    Samples whose latency is null or not finite have failed. Without ``by`` there is one row if there are samples.
    """
    value = F.col(latency).cast("double")
    good = F.coalesce(F.col(success), F.lit(False)) & F.coalesce(F.abs(value) < float("inf"), F.lit(False))
    rows = samples.select(*by, F.when(good, value).alias("v"))
    which = F.lit(0)
    if sets is not None:
        groups = [F.struct(F.lit(i).alias("which"), *(F.when(F.lit(c in s), F.col(c)).alias(c) for c in by)) for i, s in enumerate(sets)]
        rows = rows.select("v", F.explode(F.array(*groups)).alias("s")).select("v", "s.*")
        which = F.col("which")
    values = rows.select(F.struct(which.alias("which"), *by).alias("g"), "v")
    known = F.count("v")
    sizes = written(values.groupBy("g").agg(F.count(F.lit(1)).alias("total"), known.alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    at = _interpolated(values.where("v IS NOT NULL"), sizes.where("n > 0"), ["which", *by], [0.5, 0.95, 0.99])
    other = at.select(F.struct("which", *by).alias("og"), "p0", "p1", "p2")
    both = sizes.join(other, F.col("g").eqNullSafe(F.col("og")), "left")
    p99 = F.col("p2") if always_p99 else F.when(F.col("n") >= P99_LEAST, F.col("p2"))
    named = {"mean_ms": F.col("mean"), "min_ms": F.col("low"), "max_ms": F.col("high"), "p50_ms": F.col("p0"), "p95_ms": F.col("p1"), "p99_ms": p99}
    counts = [F.col("total").alias("total_samples"), F.col("n").alias("successful_samples"), (F.col("total") - F.col("n")).alias("failed_samples")]
    return both.select(*(F.col("g")[c].alias(c) for c in by), *counts, *(F.round(c, 6).alias(k) for k, c in named.items()))
