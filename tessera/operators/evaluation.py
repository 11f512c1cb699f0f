"""Retrieval quality: relevance labels, hit, reciprocal rank, recall, precision, nDCG and average precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import is_relevant
from tessera.operators.blocks import against
from tessera.operators.retrieval import FACTOR_CELLS, TEXT_CELLS, automaton, counted

METRICS = {"hit_rate": "hit", "mrr": "reciprocal_rank", "recall": "recall", "precision": "precision", "ndcg": "ndcg", "map": "average_precision"}


def total_relevant(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, total_relevant: how many of ``corpus`` (id, text) each rule (query_id, must_contain, any_of) accepts.

    Rules of bounded size go to the tasks, more of them in blocks. An automaton finds the terms of a block in one pass over a text, the
    rules are counted inside the task, and a task returns a sum a rule. A rule with a null term or list, or a null text,
    accepts nothing.
    """
    query_kind = to_arrow_type(rules.schema["query_id"].dataType)
    schema = f"query_id {rules.schema['query_id'].dataType.simpleString()}, n long"

    def count(block: list[tuple], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        for _, must, other in block:
            for t in [*must, *other]:
                if t:
                    places.setdefault(t, len(places))
        free = np.array([not other or "" in other for _, _, other in block])
        need, one = (np.zeros((len(places), len(free)), np.float32) for _ in range(2))
        for r, (_, must, other) in enumerate(block):
            need[[places[t] for t in must if t], r] = 1
            one[[places[t] for t in other if t], r] = 1
        finder, total = automaton(list(places)) if places else None, np.zeros(len(free), np.int64)
        step = max(1, TEXT_CELLS // max(len(places), len(free)))
        for whole in batches:
            texts = whole.column(0).drop_null().to_pylist()
            for start in range(0, len(texts), step):
                part = texts[start : start + step]
                found = np.zeros((len(part), len(places)), np.float32)
                if finder is not None:
                    rows, spots, _ = counted(finder, part)
                    found[rows, spots] = 1
                total += ((found @ need == need.sum(0)) & (free | (found @ one > 0))).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in block], query_kind), pa.array(total)], ["query_id", "n"])

    whole = F.col("must_contain").isNotNull() & F.col("any_of").isNotNull()
    own = rules.where(whole & ~F.exists(F.concat("must_contain", "any_of"), F.isnull)).select("query_id", "must_contain", "any_of")
    fits = lambda n, terms: n * terms <= FACTOR_CELLS or n == 1
    counts = against(corpus.select("text"), own, count, schema, fits, lambda r: len(r[1]) + len(r[2]))
    sums = counts.groupBy("query_id").agg(F.sum("n").alias("n"))
    return rules.select("query_id").distinct().join(sums, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("total_relevant"))


def labelled_hits(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """``hits`` (query_id, rank, text) with ``relevant`` by the query's rule."""
    return hits.join(rules, "query_id").withColumn("relevant", is_relevant(F.col("text"), F.col("must_contain"), F.col("any_of"))).drop("must_contain", "any_of")


def _ideal(n: Column) -> Column:
    gains = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: 1.0 / F.log2(i + 1.0))
    return F.when(n > 0, F.aggregate(gains, F.lit(0.0), lambda acc, x: acc + x)).otherwise(0.0)


def quality_details(hits: DataFrame, totals: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row per query of ``totals`` (query_id, total_relevant, ``by``) from ``hits`` (query_id, rank, relevant, ``by``).

    Precision divides by the rows returned; nDCG and average precision by what could be relevant among these. A query
    without hits has all values 0.
    """
    keys = ["query_id", *by]
    order = W.partitionBy(*keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    relevant = F.col("relevant").cast("int")
    seen = hits.withColumn("seen", F.sum(relevant).over(order))
    found = seen.groupBy(*keys).agg(
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.count(F.lit(1)).alias("returned"),
        F.sum(relevant).alias("retrieved"),
        F.sum(F.when(F.col("relevant"), 1.0 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.sum(F.when(F.col("relevant"), F.col("seen") / F.col("rank"))).alias("precisions"),
    )
    rows = totals.join(found, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    ideal = F.least(zero("total_relevant"), zero("returned"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select(
        *keys,
        F.when(zero("first") > 0, 1).otherwise(0).alias("hit"),
        zero("first").cast("int").alias("first_relevant_rank"),
        share(F.lit(1.0), zero("first")).alias("reciprocal_rank"),
        share(zero("retrieved"), zero("total_relevant")).alias("recall"),
        share(zero("retrieved"), zero("returned")).alias("precision"),
        share(zero("dcg"), _ideal(ideal)).alias("ndcg"),
        share(zero("precisions"), ideal).alias("average_precision"),
        zero("retrieved").cast("int").alias("retrieved_relevant"),
        zero("total_relevant").cast("int").alias("total_relevant"),
    )


def with_results(details: DataFrame, hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``details`` with ``results``: the hits of a query in the order of their ranks, k of them at most, as an array of
    (rank, chunk_id, document, content_sha256, relevant, score).

    ``hits`` has query_id, rank, id, document, text, relevant, score and ``by``; a query without hits has an empty array.
    """
    keys = ["query_id", *by]
    hit = F.struct("rank", F.col("id").alias("chunk_id"), "document", F.sha2("text", 256).alias("content_sha256"), "relevant", "score")
    found = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(hit)).alias("results"))
    rows = details.join(found, keys, "left")
    kind = found.schema["results"].dataType
    return rows.withColumn("results", F.coalesce("results", F.array().cast(kind)))


def quality_summary(details: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """query_count and the mean of each metric; without ``by`` and rows, query_count 0 and nulls."""
    means = [F.avg(c).alias(name) for name, c in METRICS.items()]
    return details.groupBy(*by).agg(F.count(F.lit(1)).alias("query_count"), *means)


def successful_summary(details: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """hit_rate, mrr and mean latency over the queries that succeeded; failed ones don't count at all."""
    good = details.where("success")
    return good.groupBy(*by).agg(
        F.count(F.lit(1)).alias("query_count"), F.avg("hit").alias("hit_rate"), F.avg("reciprocal_rank").alias("mrr"), F.avg("latency_ms").alias("mean_latency_ms")
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def compared(summary: DataFrame, rows: str, model: str, models: list[str], value: str) -> DataFrame:
    """One column per model."""
    return summary.groupBy(rows).pivot(model, models).agg(F.first(value))
