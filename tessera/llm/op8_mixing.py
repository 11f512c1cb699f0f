"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target share of all words. A document's expected copies are target / source size; along the source's
documents, ordered by size and id, the expected copies are summed up, one offset drawn for the source is added, and a
document is emitted once for each integer that the sum crosses.

The prefix sums are split by ranges of the whole order, not by source: a range partition is ordered in its task, what
it holds of each source is summed up, and the sums of the ranges before it, a few rows a range, are added. So a source
that holds most rows is spread over as many tasks as there are ranges. Sources themselves are ranked the same way.

Defined results: a null text has size 0; null sources form one source, ordered last; a source without words has target
0 and takes nothing; null and repeated ids are kept, rows with equal id, source and size are interchangeable; an
empty table gives no rows; other columns pass through ``mix`` untouched, whatever their names, but ``size``,
``source_size``, ``target``, ``copies`` and ``taken`` are overwritten; ``mixed_rows`` keeps these, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._shared import written
from tessera.llm._words import WORD_PATTERN

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _no_source(source: str = "source") -> list[Column]:
    """A key for sources that tells null from every string."""
    return [F.col(source).isNull().alias("_none"), F.coalesce(source, F.lit("")).alias("_source")]


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column | None], group: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with columns that sum up, over the rows before each one in ``order``, those of its ``group``; None counts.

    ``order`` has to start with the group. Rows are dealt by ranges of the order and written with their numbers; what a
    range holds of a group is one row, and these are summed up before they are added.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(dealt, "mix-ranges").withColumn("_range", F.call_function("shiftright", F.col("_at"), F.lit(33)))
    each = placed.groupBy("_range", *group).agg(F.min("_at").alias("_first"), *[(F.count(F.lit(1)) if c is None else F.sum(c)).alias(k) for k, c in sums.items()])
    ranges = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))  # one row for each range
    before = ranges.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = written(each.select("_range", *group, "_first", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums]), "mix-starts")
    own = W.partitionBy("_range", *group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    # Rows of a group follow each other in a range, so a count is the distance from the first.
    inside = {k: F.col("_at") - F.col("_first") if c is None else F.coalesce(F.sum(c).over(own), F.lit(0)) for k, c in sums.items()}
    joined = placed.join(starts, ["_range", *group])
    return joined.withColumns({k: F.col(f"_{k}") + inside[k] for k in sums}).drop("_at", "_range", "_first", *[f"_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Per source: source_size, target and offset. ``sizes`` has source, size; the result has one row per source.

    Raising a common level until the targets use up all words, each stopping at ``most`` times its source's size,
    is the fixed point of resharing the excess by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = prefix_sums(by_source, [F.col("source").asc_nulls_last()], {"number": None})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    ranked = numbered.select("source", "source_size", weight.alias("weight"))
    full = F.col("source_size") * most
    stops = full.cast("double") / F.col("weight").cast("double")
    summed = prefix_sums(ranked, [stops.asc(), F.col("source").asc_nulls_last()], {"full_before": full, "weight_before": F.col("weight")})
    everything = F.broadcast(ranked.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights")))  # one row
    left = (F.col("all_sizes") - F.col("full_before")).cast("double") / (F.col("all_weights") - F.col("weight_before")).cast("double")
    levels = summed.crossJoin(everything).select("source", "source_size", "weight", left.alias("own_level"))
    fits = F.col("own_level") <= full.cast("double") / F.col("weight").cast("double")
    level = F.broadcast(levels.agg(F.max(F.when(fits, F.col("own_level"))).alias("level")))  # one row
    low_hash = F.conv(F.substring(F.md5(F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("mix:"), "source"))), 1, 8), 16, 10)
    return levels.crossJoin(level).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("level") * F.col("weight"), full.cast("double")), F.lit(0.0)).alias("target"),
        (low_hash.cast("double") / F.lit(4294967296.0)).alias("offset"),
    )


COMPUTED = ("size", "source_size", "target", "copies", "taken")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """row, a struct of the columns of ``docs`` (doc_id, source, text or size), with what is worked out for it: COMPUTED."""
    size = F.col("size") if "size" in docs.columns and "text" not in docs.columns else word_count()
    sized = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", size.alias("size"))
    spots = written(sized.select("doc_id", "source", "size"), "mix-sizes")
    targets = written(source_targets(spots, weights, most), "mix-targets").select(*_no_source(), "source_size", "target", "offset")
    if set(docs.columns) == {"doc_id", "source", "size"}:
        sized = spots.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "size")
    order = [F.col("_none").asc(), F.col("_source").asc(), F.col("size").asc(), F.col("doc_id").asc_nulls_last()]
    ranked = prefix_sums(sized.select("row", "doc_id", "size", *_no_source()), order, {"rank": None}, ("_none", "_source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mixed = ranked.join(targets, ["_none", "_source"]).withColumn("_ratio", ratio)
    crossed = F.floor((F.col("rank") + 1) * F.col("_ratio") + F.col("offset")) - F.floor(F.col("rank") * F.col("_ratio") + F.col("offset"))
    mixed = mixed.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return mixed.select("row", *COMPUTED)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` (doc_id, source, text or size) with size, source_size, target, copies and taken."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in COMPUTED]
    return mixed_rows(docs, weights, most).select(*kept, *COMPUTED)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count().alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM by_source
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE)
         / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW b AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         coalesce(least((SELECT max(level) FROM levels WHERE level <= CAST(3 * source_size AS DOUBLE) / weight) * weight,
                        CAST(3 * source_size AS DOUBLE)), 0.0) AS target,
         CAST(CAST('0x' || substr(md5(coalesce('mix:' || source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift
  FROM levels
), ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS i
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(i * ratio + shift) - floor((i - 1) * ratio + shift), 3) AS BIGINT) * size AS taken
FROM ranked
"""
