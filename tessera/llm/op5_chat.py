"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Chat logs hold a conversation again and again as it grows. Each conversation gets a rolling hash of every prefix of its
turns; one whose whole hash is a proper prefix hash of another is a snapshot and goes (an anti-join), of equal ones the
smallest conv_id stays, and what remains is rendered. The rolling hashes are exclusive-or sums of turn hashes, so they
are built from sums per block of turns and running sums inside a block: a conversation of any length is spread over
tasks. A rendering is cut into parts of PART_TURNS turn numbers for the same reason.

Defined results: exactly repeated rows count once; rows of one conversation and turn number belong to one turn, ordered
by role and text; a null turn comes before all others; a null role is rendered as ``unknown``, a null text as empty
(but null and empty differ when conversations are compared); rows with a null conv_id are one conversation, the last in
order; an empty table gives no rows; other columns are ignored. Conversations only match if their turns carry the same
numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._shared import written

PART_TURNS = 256
BEFORE_ALL = -(1 << 62)


def _keyed(turns: DataFrame) -> DataFrame:
    at = F.coalesce(F.col("turn").cast("long"), F.lit(BEFORE_ALL))
    return turns.select(
        F.coalesce(F.concat(F.lit("id "), F.col("conv_id").cast("string")), F.lit("null")).alias("_key"),
        "conv_id",
        at.alias("_turn"),
        F.floor(at / PART_TURNS).cast("long").alias("_part"),
        "role",
        "text",
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """One row per conversation and turn: h1, h2 (of all turns up to it), n (rows so far), last (is it the last turn)."""
    parts = ["_turn", F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit(""))]
    hashed = _keyed(turns).select("_key", "conv_id", "_turn", "_part", F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b"))
    per_turn = written(
        hashed.distinct().groupBy("_key", "conv_id", "_part", "_turn").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("m")),
        "chat-turns",
    )
    per_part = per_turn.groupBy("_key", "_part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("m").alias("m"), F.max("_turn").alias("t"))
    conv = W.partitionBy("_key")
    before = conv.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = per_part.select(
        "_key",
        "_part",
        F.coalesce(F.bit_xor("a").over(before), zero).alias("a0"),
        F.coalesce(F.bit_xor("b").over(before), zero).alias("b0"),
        F.coalesce(F.sum("m").over(before), zero).alias("m0"),
        F.max("t").over(conv).alias("final"),
    )
    inside = W.partitionBy("_key", "_part").orderBy("_turn").rowsBetween(W.unboundedPreceding, 0)
    return per_turn.join(starts, ["_key", "_part"]).select(
        "_key",
        "conv_id",
        "_turn",
        F.bit_xor("a").over(inside).bitwiseXOR(F.col("a0")).alias("h1"),
        F.bit_xor("b").over(inside).bitwiseXOR(F.col("b0")).alias("h2"),
        (F.sum("m").over(inside) + F.col("m0")).alias("n"),
        (F.col("_turn") == F.col("final")).alias("last"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Conversations that are no prefix of a longer one: _key, conv_id, n_turns, n_logged (how many equal ones)."""
    prefixes = written(prefix_hashes(turns), "chat-prefixes")
    whole = prefixes.where("last").groupBy("h1", "h2", "_turn", "n").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "_key")).alias("one"), F.count(F.lit(1)).alias("n_logged")
    )
    proper = prefixes.where("NOT last").select("h1", "h2", "_turn", "n").distinct()
    kept = whole.join(proper, ["h1", "h2", "_turn", "n"], "left_anti")
    return kept.select("one._key", "one.conv_id", F.col("n").alias("n_turns"), "n_logged")


def rendered_turn() -> Column:
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_logged, rendered of the maximal conversations of ``turns`` (conv_id, turn, role, text)."""
    kept = maximal_conversations(turns)
    own = _keyed(turns).drop("conv_id").join(kept, "_key").distinct()
    line = F.struct("_turn", F.col("role").isNotNull().alias("r"), "role", F.col("text").isNotNull().alias("t"), "text", rendered_turn().alias("line"))
    parts = own.groupBy("_key", "conv_id", "_part", "n_turns", "n_logged").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    number = F.row_number().over(W.partitionBy("_key").orderBy("_part")) - 1
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return parts.select("conv_id", number.cast("long").alias("part"), "n_turns", "n_logged", text.alias("rendered"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), lines AS (
  SELECT conv_id, turn, role, text, floor(coalesce(turn, {BEFORE_ALL}) / {PART_TURNS}.0) AS p,
         coalesce(CAST(turn AS VARCHAR), 'null') || chr(1) || coalesce(role, chr(0)) || chr(1) || coalesce(text, chr(0)) || chr(2) AS item FROM t
), prefixes AS (
  SELECT conv_id, turn, count(*) OVER c AS n, string_agg(item, '') OVER c AS prefix,
         turn IS NOT DISTINCT FROM max(turn) OVER (PARTITION BY conv_id) AS last
  FROM lines
  WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
), whole AS (
  SELECT min(conv_id) AS conv_id, prefix, n AS n_turns, count(*) AS n_logged
  FROM (SELECT conv_id, arg_max(prefix, n) AS prefix, max(n) AS n FROM prefixes GROUP BY conv_id) GROUP BY prefix, n
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.prefix = w.prefix AND NOT p.last)
)
SELECT k.conv_id, row_number() OVER (PARTITION BY k.conv_id ORDER BY p) - 1 AS part, k.n_turns, k.n_logged,
       string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
                  ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM kept k JOIN lines l ON k.conv_id IS NOT DISTINCT FROM l.conv_id
GROUP BY k.conv_id, p, k.n_turns, k.n_logged
"""
