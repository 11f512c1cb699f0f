"""Every row of a query set against every row of a corpus.

A query set of bounded size goes to all tasks of the corpus scan. A larger one meets the corpus in blocks: both are packed
into blocks of bounded size, the blocks of the corpus are dealt over salts, once each, and the blocks of the queries go to
every salt. So whatever the number of queries, the corpus is scanned and shuffled once, and nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A packed block of either side has at most so many bytes and rows, or one row.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8192
#: Salts for each shuffle partition, so that these are filled evenly.
SALTS = 4

Core = Callable[[list[tuple], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` as blocks, each an Arrow stream in the column ``data``."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, held[0].schema) as stream:
            for b in held:
                stream.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for whole in batches:
            step = max(1, min(BLOCK_ROWS, whole.num_rows * BLOCK_BYTES // max(whole.nbytes, 1)))
            for start in range(0, whole.num_rows, step):
                part = whole.slice(start, step)
                if held and (size + part.nbytes > BLOCK_BYTES or n + part.num_rows > BLOCK_ROWS):
                    yield block(held)
                    held, size, n = [], 0, 0
                held.append(part)
                size, n = size + part.nbytes, n + part.num_rows
        if held:
            yield block(held)

    return rows.mapInArrow(run, "data binary")


def unpacked(data: bytes) -> list[pa.RecordBatch]:
    with pa.ipc.open_stream(data) as stream:
        return [b for b in stream]


def bounded(queries: DataFrame, fits: Callable[[int, int], bool], weigh: Callable[[tuple], int]) -> list[tuple] | None:
    """The rows of ``queries``, or None once they no longer fit; no more than that is brought to the driver."""
    items, weight = [], 0
    for r in queries.toLocalIterator():
        items.append(tuple(r))
        weight += weigh(items[-1])
        if not fits(len(items), weight):
            return None
    return items


def against(corpus: DataFrame, queries: DataFrame, core: Core, schema: str, fits: Callable[[int, int], bool], weigh: Callable[[tuple], int]) -> DataFrame:
    """What ``core`` finds for all ``queries`` in all of ``corpus``.

    ``core`` gets some queries, as tuples, that fit together (their number and the sum of what they ``weigh``), and
    batches of the corpus; results of several calls have to be put together by the caller.
    """
    items = bounded(queries, fits, weigh)
    if items == []:
        return corpus.sparkSession.createDataFrame([], schema)
    if items is not None:
        shared = corpus.sparkSession.sparkContext.broadcast(items)
        return corpus.mapInArrow(lambda batches: core(shared.value, batches), schema)

    def parts(rows: list[tuple]) -> Iterator[list[tuple]]:
        some, weight = [], 0
        for r in rows:
            if some and not fits(len(some) + 1, weight + weigh(r)):
                yield some
                some, weight = [], 0
            some.append(r)
            weight += weigh(r)
        yield some

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in batches:
            for own, other in zip(pairs.column(0), pairs.column(1), strict=True):
                rows = [r for b in unpacked(own.as_py()) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                for some in parts(rows):
                    yield from core(some, iter(unpacked(other.as_py())))

    salts = SALTS * int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed(corpus).select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"), F.col("data").alias("other"))
    every = packed(queries).select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("data").alias("own"))
    return dealt.join(every, "salt").select("own", "other").mapInArrow(meet, schema)
