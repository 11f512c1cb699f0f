"""What several operators need: intermediate tables in the shared folder, bounded membership sketches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that share so many rows may be hot; at most HOT_KEYS of them are dealt over PARTS parts.
HOT_ROWS = 500
HOT_KEYS = 4096
PARTS = 64
#: From Spark 4.1 on; others ignore it.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes an action's shuffle files when the action ends, not whenever the driver collects its garbage.

    For a chain of tables that are ``written`` one after the other, so that no action reads another's shuffle files. The
    session's setting holds for its other threads meanwhile: a frame that these run twice is computed twice.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def membership_sketch(df: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """A bitmap of 2**bits bits with one bit set for each value of a long column.

    Its size is fixed whatever the data, so it can be broadcast. It may hold values that are not in ``df``
    (an exact join has to follow), but misses none.
    """
    spot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        df.where(F.col(column).isNotNull())
        .select(F.bitmap_bucket_number(spot).alias("b"), F.bitmap_bit_position(spot).alias("p"))
        .groupBy("b")
        .agg(F.bitmap_construct_agg("p").alias("m"))
        .collect()  # at most 2**bits / 32768 rows of 4 KB
    )
    out = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for b, m in rows:
        # Values 1..32768 are in bucket 1, at positions 0..32767; 0 is in bucket 0, at its position's absolute value.
        out[b * 4096 : b * 4096 + 4096] |= np.frombuffer(bytes(m), np.uint8)
    return out


def in_sketch(sketch: np.ndarray, values: np.ndarray, bits: int = 25) -> np.ndarray:
    """Which of the longs may be members."""
    spot = values.astype(np.int64) & ((1 << bits) - 1)
    bucket = np.where(spot > 0, 1 + (spot - 1) // 32768, 0)
    place = np.where(spot > 0, (spot - 1) % 32768, 0)
    return (sketch[bucket * 4096 + place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1


def only(rows: DataFrame, sketch, inside: bool, bits: int = 25) -> DataFrame:
    """The rows whose long column ``key`` a broadcast sketch may hold, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_sketch(sketch.value, batch.column("key").to_numpy(), bits) == inside))

    return rows.mapInArrow(run, rows.schema)


def spread_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side``, which has few rows for each value of the long column ``key``.

    The rows of the most frequent keys are dealt over PARTS parts by a hash of ``by``, and those keys' side is repeated
    for each. They are HOT_KEYS at most, so any other key has less than that part of the rows; rows without a key are dealt,
    too. ``rows`` is read twice.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    hot = [(r[0],) for r in counts.orderBy(F.desc("_n"), key).limit(HOT_KEYS).collect()]
    if not hot:
        return rows.join(side, key, how)
    marks = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} long").withColumn("_hot", F.lit(True)))
    dealt = rows.join(marks, key, "left").withColumn("_part", F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = side.join(marks, key, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


def _apart(docs: DataFrame, key: Column, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (row, row_key) in two parts: rows whose ``key``, a struct, can't be in ``listed`` (row_key), the rest.

    Only the key's hash goes to Python; the rows stay in the JVM.
    """
    sketch = docs.sparkSession.sparkContext.broadcast(membership_sketch(listed.select(F.xxhash64("row_key").alias("key")), "key"))

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(in_sketch(sketch.value, keys.to_numpy(zero_copy_only=False)))

    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("row_key"))
    inside = may(F.xxhash64("row_key"))
    return keyed.where(~inside), keyed.where(inside)


def drop_rows(docs: DataFrame, key: Column, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``bad``. Only rows that may be are shuffled."""
    safe, rest = _apart(docs, key, bad)
    return safe.select("row.*").unionByName(rest.join(bad, "row_key", "left_anti").select("row.*"))


def keep_one(docs: DataFrame, key: Column, special: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``special`` (row_key, keep) doesn't keep; of those that it keeps, one with each key."""
    safe, rest = _apart(docs, key, special)
    checked = rest.join(special, "row_key", "left").where(F.coalesce("keep", F.lit(True))).dropDuplicates(["row_key"])
    return safe.select("row.*").unionByName(checked.select("row.*"))
