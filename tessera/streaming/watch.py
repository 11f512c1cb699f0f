"""Continuous ingestion of a folder, and latency summaries over event time.

The built-in file source reports new files only. This source's offset is a number, the time of a look; the looks
themselves are tables. In a look the folder's files are listed in parts, by tasks. A join with the look before says whether the folder is
quiet, and one with the look that was handled last what has changed since: added, updated and removed files. A batch
runs the full scan, so a lost event does no harm, and nothing of the folder's size is kept in offsets or in the driver.
"""

from __future__ import annotations

import logging
import os
import time
import zlib
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.tables import fresh_path

QUIET_MS = 650
#: So many tasks share the files of a look.
PARTS = 4
LISTING = "path string, state string"


def listed(root: str, part: int = 0, parts: int = 1) -> Iterator[tuple[str, str]]:
    """Path and state (time of change and size) of the files under a folder, or of one of ``parts`` shares of them.

    Links aren't followed; every share walks the folders and looks at its own files only.
    """
    for folder, _, names in os.walk(root, followlinks=False):
        for name in names:
            path = os.path.join(folder, name)
            if zlib.crc32(os.fsencode(path)) % parts != part:
                continue
            try:
                state = os.stat(path, follow_symlinks=False)
            except OSError:
                continue
            yield path, f"{state.st_mtime_ns}:{state.st_size}"


def snapshot(root: str) -> dict[str, str]:
    """Path to state of all files under a folder."""
    return dict(listed(root))


class FolderReader(DataSourceStreamReader):
    """The listing of a folder at each look; the offset is the time of the look in milliseconds."""

    def __init__(self, root: str, parts: int):
        self.root, self.parts = root, parts

    def initialOffset(self) -> dict:
        return {"look": 0}

    def latestOffset(self, *_) -> dict:
        return {"look": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        return listed(self.root, partition.value, self.parts)


class FolderSource(DataSource):
    """``spark.readStream.format("folder").option("path", ...)``; all executors see the folder under that path."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("parts", PARTS)))


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, updated) between two listings (path, state)."""
    both = old.select("path", F.col("state").alias("was")).join(new.select("path", F.col("state").alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("updated")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("path", change.alias("change"))


class Looks:
    """The last two looks at a folder and the ones that were handled, as tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str = LISTING) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None

    def handled(self) -> DataFrame:
        every = self._read("handled", f"{LISTING}, number long")
        last = None if every is None else every.agg(F.max("number")).first()[0]
        return self.spark.createDataFrame([], LISTING) if last is None else every.where((F.col("number") == last) & F.col("path").isNotNull()).drop("number")

    def changes(self, listing: DataFrame, number: int) -> tuple[DataFrame, DataFrame] | None:
        """What is new since the look handled last, and this look, once it equals the one before."""
        listing.write.mode("overwrite").parquet(f"{self.path}/look-{number % 2}")
        now, before = self._read(f"look-{number % 2}"), self._read(f"look-{(number - 1) % 2}")
        if before is None or not differences(before, now).isEmpty():
            return None
        return differences(self.handled(), now), now

    def handle(self, now: DataFrame, number: int) -> None:
        # A row without a path makes the number known even if the folder is empty.
        marked = now.unionByName(self.spark.createDataFrame([(None, None)], LISTING))
        marked.write.mode("overwrite").parquet(f"{self.path}/handled/number={number}")


def watch(spark: SparkSession, root: str, on_change: Callable[[DataFrame], None], checkpoint: str | None = None, every_ms: int = QUIET_MS) -> StreamingQuery:
    """Calls ``on_change`` with the changes (path, change) once the folder is quiet; an error in it is logged and the watch goes on.

    With ``checkpoint`` a new watch goes on where the last one stopped; its looks are kept beside it.
    """
    spark.dataSource.register(FolderSource)
    looks = Looks(spark, f"{checkpoint.rstrip('/')}-looks" if checkpoint else fresh_path(spark, "looks"))

    def handle(listing: DataFrame, number: int) -> None:
        found = looks.changes(listing, number)
        if found is None or found[0].isEmpty():
            return
        try:
            on_change(found[0])
        except Exception:
            logging.getLogger(__name__).exception("scan after a change failed")
        looks.handle(found[1], number)

    writer = spark.readStream.format("folder").option("path", root).load().writeStream.foreachBatch(handle)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{every_ms} milliseconds").start()


def latency_windows(samples: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and latency of tumbling windows over ``samples`` (ts, value, event_type), in a stream or a batch."""
    good = F.col("event_type") != "error"
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = timed.withWatermark("ts", late) if samples.isStreaming else timed
    return rows.groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(good).alias("succeeded"), F.avg(F.when(good, F.col("value"))).alias("mean_ms"), F.max(F.when(good, F.col("value"))).alias("max_ms")
    )
