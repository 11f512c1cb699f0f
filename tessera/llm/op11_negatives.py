"""Hard-negative mining: for an anchor and each of its best positives, the best rows of other labels that score almost as high.

Each vector is stored in blocks together with the mean and the deviation (the root of the sum of squared differences
from the mean) of its segments. In a segment of n components the inner product of two vectors lies within
n * mean * mean, plus or minus deviation * deviation, so sums over segments bound the score. A block of anchors is
compared with a block of rows by the bounds of long segments; pairs that these leave open by those of segments half as
long, and so on; what then still can be among the best is scored exactly. The k-th best lower bound of an anchor in the block is what others have
to reach, so no row that counts is lost.

First each anchor's positives are found, then, with their scores as limits, its negatives. All anchors meet all rows, in
pairs of blocks of bounded size: the blocks of anchors go to every block of rows, which has a key of its own and is sent
once. A task returns its best few rows for each anchor, and a window over these few
picks the best of all. Scores are exact integers as long as dimension times the largest squared component stays below
2^53, beyond that 64-bit integers.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no part; vectors of
another dimension aren't compared, nor are empty ones; a null id makes no anchor and comes last among ties. Of repeated
rows each counts: all but the anchor's own row may be its positives, and repeated anchors have results each. A label
with one row has no positives; negative positive-scores have no negatives. Other columns are ignored; empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._shared import written

ROW_BLOCK, ANCHOR_BLOCK = 4096, 1024
#: Segments are halved from this length down to SHORTEST.
LONGEST, SHORTEST = 16, 4
#: Pairs are taken one by one where no more than this share of them is open.
SPARSE = 0.02
#: So many anchors of a block are compared with the other block at a time.
STRIP = 128
POSITIVES = NEGATIVES = 5
#: A negative scores between these hundredths of its positive's score.
LOW, HIGH = 80, 100
_EXACT = 1 << 53
MOST_TASKS = 20_000
_BLOCK = "block int, dim int, row array<long>, id array<long>, label array<long>, vector binary, segments binary, limits array<array<long>>"


def lengths() -> list[int]:
    return [n for n in (LONGEST >> i for i in range(64)) if n >= SHORTEST]


def summaries(vectors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of ``length`` components (the last may be shorter), scaled by the root of its length."""
    starts = np.arange(0, vectors.shape[1], length)
    sizes = np.diff(np.append(starts, vectors.shape[1]))
    means = np.add.reduceat(vectors, starts, axis=1) / sizes
    apart = (vectors - np.repeat(means, sizes, axis=1)) ** 2
    return means * np.sqrt(sizes), np.sqrt(np.add.reduceat(apart, starts, axis=1))


def eligible(rows: DataFrame, scale: int) -> DataFrame:
    """id, label, vector (scaled and rounded down) of the rows that take part, each with a number of its own, as a table."""
    fit = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("label").isNotNull() & (F.size("vector") > 0) & fit)
    whole = F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return written(valid.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("vector")), "vectors")


def packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows and how many block numbers there are; a block number has a block for each dimension."""
    limits = F.col("limits") if "limits" in rows.columns else F.lit(None).cast("array<bigint>").alias("limits")
    n = max(1, -(-rows.count() // size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)  # one block of bounded size
        dims = np.array([len(v) for v in table.column("vector")])
        for dim in np.unique(dims).tolist():
            part = table.take(np.flatnonzero(dims == dim))
            vectors = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            levels = [x for n in lengths() for x in summaries(vectors.astype(np.float64), n)]
            out = {"block": [TaskContext.get().partitionId()], "dim": [dim]} | {c: [part.column(c).to_pylist()] for c in ("row", "id", "label", "limits")}
            out |= {"vector": [vectors.astype(np.int64).tobytes()], "segments": [np.concatenate(levels, axis=1).astype(np.float32).tobytes()]}
            kinds = pa.schema([("block", pa.int32()), ("dim", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("row", "id", "label")), ("vector", pa.binary()), ("segments", pa.binary()), ("limits", pa.list_(pa.list_(pa.int64())))])
            yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in kinds}, kinds)

    return written(rows.select("row", "id", "label", "vector", limits).repartition(n).mapInArrow(pack, _BLOCK), name), n


class Block:
    """A packed block in a task."""

    def __init__(self, dim: int, row: list, id: list, label: list, vector: bytes, segments: bytes, limits: list | None = None):
        self.dim, self.row, self.label = dim, np.array(row, np.int64), np.array(label, np.int64)
        self.id = id
        self.order = np.array([np.iinfo(np.int64).max if i is None else i for i in id], np.int64)
        self.vector = np.frombuffer(vector, np.int64).reshape(len(row), dim)
        self.limits = limits
        all_levels, at, self.levels = np.frombuffer(segments, np.float32).reshape(len(row), -1), 0, []
        for n in lengths():
            size = -(-dim // n)
            self.levels.append((all_levels[:, at : at + size], all_levels[:, at + size : at + 2 * size]))
            at += 2 * size
        self.largest = int(max(abs(int(self.vector.max())), abs(int(self.vector.min()))))

    def strip(self, a: int, b: int) -> Block:
        out = object.__new__(Block)
        out.dim, out.row, out.label, out.vector, out.largest = self.dim, self.row[a:b], self.label[a:b], self.vector[a:b], self.largest
        out.levels = [(m[a:b], d[a:b]) for m, d in self.levels]
        out.limits = None if self.limits is None else self.limits[a:b]
        return out


def _whole(anchors: Block, rows: Block) -> type:
    """The kind of number that holds every score of the two blocks exactly."""
    return np.float64 if anchors.dim * anchors.largest * rows.largest < _EXACT else np.int64


def _bounds(anchors: Block, rows: Block, level: int, a: np.ndarray | None = None, r: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all pairs, or of the pairs (a, r), with room for rounding."""
    (ma, da), (mr, dr) = anchors.levels[level], rows.levels[level]
    size = lambda m, d: np.sqrt((m * m).sum(1) + (d * d).sum(1))
    room = 1e-5 * float(size(ma, da).max(initial=0)) * float(size(mr, dr).max(initial=0)) + 1e-3
    if a is None:
        middle, spread = ma @ mr.T, da @ dr.T
    else:
        middle, spread = np.einsum("ij,ij->i", ma[a], mr[r]), np.einsum("ij,ij->i", da[a], dr[r])
    spread += room
    return middle - spread, middle + spread


def _kth(values: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest value that fits of each row, or less than any where there are fewer."""
    least = -np.inf if values.dtype.kind == "f" else np.iinfo(values.dtype).min
    if values.shape[1] < k:
        return np.full(len(values), least)
    return np.partition(np.where(fits, values, least), -k, axis=1)[:, -k]


def _best(a: np.ndarray, r: np.ndarray, scores: np.ndarray, rows: Block, k: int) -> np.ndarray:
    """Which pairs are the first k of their anchor: by score, then by id."""
    order = np.lexsort((rows.row[r], rows.order[r], -scores, a))
    sorted_a = a[order]
    starts = np.flatnonzero(np.append(True, sorted_a[1:] != sorted_a[:-1])) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return order[rank < k]


def _above(anchors: Block, rows: Block, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each line of ``low`` and ``high`` the first k allowed rows of each anchor with a score in [low, high]: anchors, rows, scores.

    The bounds of all pairs are matrix products, and so are the scores if many pairs stay open; few are taken one by one.
    """
    lower = upper = None
    left, last = allowed, len(anchors.levels) - 1
    for level in range(last + 1):
        now = _bounds(anchors, rows, level)
        lower, upper = now if lower is None else (np.maximum(lower, now[0]), np.minimum(upper, now[1]))
        reach = low.min(0).astype(np.float64)
        if len(low) == 1 or level == last:  # k pairs that surely count are as good as their lower bounds
            sure = [_kth(lower, allowed & (lower >= lo[:, None]) & (upper <= hi[:, None]), k) for lo, hi in zip(low, high, strict=True)]
            reach = np.minimum.reduce([np.maximum(lo, x) for lo, x in zip(low, sure, strict=True)])
        left = allowed & (upper >= reach[:, None]) & (lower <= high.max(0)[:, None])
        if left.mean() <= SPARSE:
            break
    kind = _whole(anchors, rows)
    if left.mean() > SPARSE:
        scores = anchors.vector.astype(kind) @ rows.vector.astype(kind).T
        for lo, hi in zip(low, high, strict=True):
            fits = left & (scores >= lo[:, None]) & (scores <= hi[:, None])
            a, r = np.nonzero(fits & (scores >= _kth(scores, fits, k)[:, None]))
            yield _picked(a, r, scores[a, r].astype(np.int64), rows, k)
        return
    a, r = np.nonzero(left)
    for finer in range(level + 1, last + 1):
        lower, upper = _bounds(anchors, rows, finer, a, r)
        keep = (upper >= low.min(0)[a]) & (lower <= high.max(0)[a])
        a, r = a[keep], r[keep]
    scores = np.einsum("ij,ij->i", anchors.vector[a].astype(kind), rows.vector[r].astype(kind)).astype(np.int64)
    for lo, hi in zip(low, high, strict=True):
        fits = (scores >= lo[a]) & (scores <= hi[a])
        yield _picked(a[fits], r[fits], scores[fits], rows, k)


def _picked(a: np.ndarray, r: np.ndarray, scores: np.ndarray, rows: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pick = _best(a, r, scores, rows, k)
    return a[pick], r[pick], scores[pick]


_FOUND = "anchor long, anchor_id long, place int, row long, id long, score long"


def _compared(rows: tuple[DataFrame, int], anchors: tuple[DataFrame, int], compare) -> DataFrame:
    """What ``compare`` finds in each pair of blocks: anchor row and id, place of the positive, row, id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch.slice(i, 1).to_pylist()[0]
                own, other = Block(pair["dim"], **pair["a"]), Block(pair["dim"], **pair["r"])
                for start in range(0, len(own.row), STRIP):
                    strip = own.strip(start, start + STRIP)
                    for place, a, r, scores in compare(strip, other):
                        columns = [strip.row[a], [own.id[start + i] for i in a], np.full(len(a), place, np.int32), other.row[r], [other.id[i] for i in r], scores]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["anchor", "anchor_id", "place", "row", "id", "score"])

    (r, n), a = rows, anchors[0]
    content = ["row", "id", "label", "vector", "segments"]
    left = r.select("block", "dim", F.struct(*content).alias("r"))
    right = a.select("dim", F.struct(*content, "limits").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    key, tasks = ["block", "dim"], min(n, MOST_TASKS)
    return left.repartition(tasks, *key).join(right.repartition(tasks, *key), key).select("dim", "a", "r").mapInArrow(run, _FOUND)


def _positives(k: int):
    def compare(anchors: Block, rows: Block):
        allowed = (anchors.label[:, None] == rows.label[None, :]) & (anchors.row[:, None] != rows.row[None, :])
        none, every = (np.full((1, len(anchors.row)), x, np.int64) for x in (np.iinfo(np.int64).min, np.iinfo(np.int64).max))
        yield from ((0, *found) for found in _above(anchors, rows, allowed, none, every, k))

    return compare


def _negatives(k: int, low: int, high: int):
    def compare(anchors: Block, rows: Block):
        allowed = anchors.label[:, None] != rows.label[None, :]
        # A limit below 0 has no negatives, as the range between its hundredths is empty.
        limits = [[x[place] if len(x) > place else -1 for x in anchors.limits] for place in range(max(map(len, anchors.limits)))]
        least, top = (np.array([[f(x) for x in line] for line in limits], np.int64) for f in (lambda x: -(-low * x // 100), lambda x: high * x // 100))
        yield from ((place, *found) for place, found in enumerate(_above(anchors, rows, allowed, least, top, k), 1))

    return compare


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (id, label, vector).

    ``anchor`` says of a row whether it is an anchor. Components count in steps of 1 / ``scale``, rounded down.
    """
    table = eligible(rows, scale)
    blocks = packed(table, ROW_BLOCK, "vector-blocks")
    own = table.where(anchor)
    best = written(_first(_compared(blocks, packed(own, ANCHOR_BLOCK, "anchor-blocks"), _positives(positives)), positives, "anchor"), "positives")
    limits = best.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("limits"))  # ``positives`` at most
    limited = written(own.join(limits, "row"), "anchors")
    found = _compared(blocks, packed(limited, ANCHOR_BLOCK, "limited-blocks"), _negatives(negatives, low, high))
    ranked = _first(found, negatives, "anchor", "place")
    known = best.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(known, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stored.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


SQL = """
WITH flat AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN floor(256 * x::DOUBLE) END) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), r AS (
    SELECT row_number() OVER () AS row, vec_id, label, v FROM flat WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL)) = 0
), pairs AS (
    SELECT a.row AS a, a.vec_id AS anchor_id, a.label = r.label AS same, r.row, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM r AS a JOIN r ON a.row <> r.row AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, row) AS place FROM pairs WHERE same QUALIFY place <= 5
), ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.row ORDER BY n.score DESC, n.vec_id, n.row) AS rank,
        n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives AS p JOIN pairs AS n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
