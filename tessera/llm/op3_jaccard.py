"""N-gram Jaccard join by vertical partitioning.

The n-grams (word shingles) have one global order, that of their hashes. It is cut into fragments, and with it each
document's set into segments:

* Candidates: two sets of at least the threshold differ in so few n-grams that, with more fragments than that, some of
  their segments are equal. Equal segments meet by a shuffle of their hashes. Sets that meet others too seldom for a
  link of theirs are out of it; the rest meets again. In a small meeting all pairs are noted,
  and a pair stays if it meets as often as the threshold demands of sets of these sizes, where large meetings of both may
  have been of each other. Sets whose large meetings are enough for that without small ones are joined with the first of
  each: these are the crowds. The connected groups of both are the candidate groups. The number of fragments depends on
  a set's size class, and a set takes part in its own class and the next smaller one. A few spare fragments make up for
  segments that are empty; sets with more empty ones than that also meet by these.
* Counting: the order is cut into FRAGMENTS fragments. The overlap of a pair is counted in each fragment apart, in tasks
  that hold that fragment's segments only, and the partial counts are summed up per pair. Each set is first counted
  against its group's hub, the set that meets others most often; a group of near copies is mostly settled by that.
  Sets that aren't linked with their hub are left open. Their pairs are counted one by one; in a crowd, which has no
  list of pairs, they are counted against all its other sets: both are cut into blocks, and a fragment's partial counts
  of a pair of blocks are one matrix.

Links and components are exact (up to 64-bit hashes of n-grams and sets). Equal sets are one node throughout, so copies
are never paired with each other, and pairs of sets that are both linked with their hub aren't counted.

Defined results: a text without words, or null, has an empty set, no links, and is its own component; with fewer words
than an n-gram has, the whole sequence is the one n-gram; a null id takes part, and a component without any other id
has a null component_id; repeated rows are linked with each other; an empty table gives no rows; other columns of
``docs`` are ignored. Texts are taken in slices of about 1 MB; a longer one is held whole, with temporaries of some 25
times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._graph import components
from tessera.llm._shared import in_sketch, membership_sketch, only, shuffle_files_dropped, spread_join, written
from tessera.llm._words import gram_hashes, mix64, slices, text_buffer, word_hashes, word_spans

SHINGLE = 4
PERCENT = 85
FRAGMENTS = 4
BLOCK_SETS = 512
BLOCK_GRAMS = 500_000
#: So many sets a task remembers, in order to put out equal ones once.
REMEMBERED = 1 << 16
DENSE_CELLS = 1 << 20
FEW = 8
SMALL_MEETING = 16


def size_classes(most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest set size and number of fragments of each class, up to sets of ``most``."""
    top, upper = 0, []
    while top < most:
        top = (top + 1) * 100 // percent
        upper.append(top)
    tops = np.array(upper or [1], np.int64)
    return tops, tops * (100 - percent) // percent + 1


def spare(fragments: np.ndarray) -> np.ndarray:
    return np.where(fragments > 1, 2 + fragments // 10, 0)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes and their rows, ordered by row and hash."""
    buf, offs = text_buffer(column, lower=True)
    s, e, rows = word_spans(buf, offs)
    words = word_hashes(buf, s, e)
    grams, at = gram_hashes(words, rows, n)
    parts, owners = [grams], [rows[at]]
    if len(rows):
        own, start, count = np.unique(rows, return_index=True, return_counts=True)
        for size in range(1, n):
            short = start[count == size]
            if len(short):
                h, at = gram_hashes(words, rows, size)
                here = np.isin(at, short)
                parts.append(h[here])
                owners.append(rows[at[here]])
    grams, owners = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], owners[new]


def set_hashes(grams: np.ndarray, owners: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each row's set and its hash."""
    sizes = np.bincount(owners, minlength=n_rows)
    sums = np.zeros(n_rows, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[some]
        sums[some] = np.add.reduceat(mix64(grams), starts)
    return sizes, mix64(sums + sizes.astype(np.uint64)).astype(np.int64)


def _marked(sigs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Signatures whose last bit says whether their size class is odd; a set has two classes, one of each kind."""
    return (sigs & ~np.uint64(1)) | (classes & 1).astype(np.uint64)


def empty_segments(grams: np.ndarray, owners: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many segments of each set are empty, in its own class and in the next smaller one."""
    tops, needed = size_classes(int(sizes.max(initial=0)), percent)
    fragments, own = needed + spare(needed), np.searchsorted(tops, sizes)
    out = []
    for step in (0, 1):
        k = fragments[np.maximum(own - step, 0)]
        place = ((grams >> np.uint64(32)) * k.astype(np.uint64)[owners]) >> np.uint64(32)
        new = np.ones(len(grams), bool)
        new[1:] = (place[1:] != place[:-1]) | (owners[1:] != owners[:-1])
        out.append(k - np.bincount(owners[new], minlength=len(sizes)))
    return out[0], out[1]


def enough_meetings(sizes: tuple, empties: tuple, odd: np.ndarray, meetings: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sets meet as often, in the class of the smaller set, as a similarity of ``percent`` demands."""
    (a, b), (a_own, a_below, b_own, b_below) = sizes, empties
    tops, needed = size_classes(int(max(a.max(initial=0), b.max(initial=0))), percent)
    fragments = needed + spare(needed)
    low, high = np.minimum(a, b), np.maximum(a, b)
    ca, cb = np.searchsorted(tops, a), np.searchsorted(tops, b)
    c = np.minimum(ca, cb)
    both_empty = np.minimum(np.where(ca == c, a_own, a_below), np.where(cb == c, b_own, b_below))
    differ = (a + b) * (100 - percent) // (100 + percent)
    least = np.maximum(1, fragments[c] - differ - both_empty)
    return (100 * low >= percent * high) & (odd == c % 2) & (meetings >= least)


def can_link(sizes: np.ndarray, own: np.ndarray, below: np.ndarray, even: np.ndarray, odd: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets have enough segments that others have too, for any link of theirs. ``even`` and ``odd`` count these
    by class, ``own`` and ``below`` are the numbers of empty segments."""
    tops, needed = size_classes(int(sizes.max(initial=0)), percent)
    fragments, c = needed + spare(needed), np.searchsorted(tops, sizes)
    lower = np.maximum(c - 1, 0)
    least_own = fragments[c] - sizes * (100 - percent) // percent - own
    least_below = fragments[lower] - (tops[lower] + sizes) * (100 - percent) // (100 + percent) - below
    met_own, met_below = np.where(c % 2 == 1, odd, even), np.where(c % 2 == 1, even, odd)
    return (met_own >= np.maximum(1, least_own)) | ((c > 0) & (met_below >= np.maximum(1, least_below)))


def signatures(grams: np.ndarray, owners: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the segments of each row's set, for its size class and the next smaller one, and their rows."""
    tops, needed = size_classes(int(sizes.max(initial=0)), percent)
    fragments = needed + spare(needed)
    own = np.searchsorted(tops, sizes)
    sigs, rows = [], []
    for step in (0, 1):
        c = own - step
        ok = (c >= 0) & (sizes > 0)
        if step:  # only what some set of the smaller class can reach
            ok &= sizes <= tops[np.maximum(c, 0)] * 100 // percent
        pick = ok[owners]
        if not pick.any():
            continue
        g, r = grams[pick], owners[pick]
        k = np.where(ok, fragments[np.maximum(c, 0)], 1).astype(np.uint64)
        place = ((g >> np.uint64(32)) * k[r]) >> np.uint64(32)
        new = np.ones(len(g), bool)
        new[1:] = (place[1:] != place[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(g))).astype(np.uint64)
        tag = mix64((c[r[at]].astype(np.uint64) << np.uint64(32)) ^ place[at])
        full = mix64(np.add.reduceat(mix64(g), at) + count * np.uint64(0x9FB21C651E98DF25)) ^ tag
        sigs.append(_marked(full, c[r[at]]))
        rows.append(r[at])
        filled = np.bincount(r[at], minlength=len(sizes))
        sparse = np.flatnonzero(ok & (k.astype(np.int64) - filled > spare(needed)[np.maximum(c, 0)]))
        for row in sparse:
            empty = np.setdiff1d(np.arange(int(k[row])), place[at][r[at] == row].astype(np.int64)).astype(np.uint64)
            full = mix64(mix64((np.uint64(c[row]) << np.uint64(32)) ^ empty) ^ np.uint64(0xE7037ED1A0B428DB))
            sigs.append(_marked(full, np.full(len(empty), c[row])))
            rows.append(np.full(len(empty), row))
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs).astype(np.int64), np.concatenate(rows)


class Seen:
    """Which values come for the first time, as far as a memory of bounded size can tell."""

    def __init__(self):
        self.values: set[int] = set()

    def first(self, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        out = wanted.copy()
        for i in np.flatnonzero(wanted):
            if (value := int(values[i])) in self.values:
                out[i] = False
            elif len(self.values) >= REMEMBERED:
                self.values = {value}
            else:
                self.values.add(value)
        return out


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def _described(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, node (hash of the set; null if empty), n_shingles, e_own, e_below (empty segments in its two classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, owners = shingle_sets(batch.column("text"), shingle)
            sizes, nodes = set_hashes(grams, owners, batch.num_rows)
            own, below = empty_segments(grams, owners, sizes, percent)
            columns = [batch.column("doc_id"), pa.array(nodes, pa.int64(), mask=sizes == 0), *(pa.array(x, pa.int64()) for x in (sizes, own, below))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n_shingles", "e_own", "e_below"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n_shingles long, e_own long, e_below long")


def _segments(docs: DataFrame, shingle: int, percent: int, sketch=None) -> DataFrame:
    """sig, node: the signatures of each set, or of those of the documents in the sketch; a task puts out equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            if sketch is not None:
                batch = batch.filter(pa.array(in_sketch(sketch.value, batch.column("key").to_numpy())))
            for part in slices(iter([batch])):
                grams, owners = shingle_sets(part.column("text"), shingle)
                sizes, nodes = set_hashes(grams, owners, part.num_rows)
                new = seen.first(nodes, sizes > 0)
                use = new[owners]
                sigs, rows = signatures(grams[use], owners[use], np.where(new, sizes, 0), percent)
                yield pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(nodes[rows])], ["sig", "node"])

    return docs.select("text", F.xxhash64("doc_id").alias("key")).mapInArrow(run, "sig long, node long")


def meetings(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of whole meetings (runs of equal signatures): all with kind 0 or 1 (is the class odd) of a small meeting,
    those of the first one with everybody, itself too, of kind 2 or 3, of a larger one."""
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    run, start = np.cumsum(new) - 1, np.flatnonzero(new)
    size = np.diff(np.append(start, len(sig)))[run] if len(sig) else run
    large = np.flatnonzero(size > SMALL_MEETING)
    a, b, kind = [node[start[run[large]]]], [node[large]], [2 + (sig[large] & 1)]
    small = np.flatnonzero((size > 1) & (size <= SMALL_MEETING))
    r, v, s = run[small], node[small], sig[small]
    for step in range(1, SMALL_MEETING):
        same = np.flatnonzero(r[step:] == r[:-step])
        if not len(same):
            break
        a.append(v[same])
        b.append(v[same + step])
        kind.append(s[same] & 1)
    return np.concatenate(a), np.concatenate(b), np.concatenate(kind)


def _candidates(docs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) and edges (a, b) of crowds: a pair over the threshold is among the former or inside a connected group
    of the latter. And the sets that can have links: node, n, o, b, even, odd."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by signature and node. A run that is cut off waits for its rest; of a large one the first waits."""
        sig, node, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def batch_of(a, b, kind) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(kind, pa.int64())], ["a", "b", "kind"])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, v = (batch.column(c).to_numpy() for c in ("sig", "node"))
            if large is not None:
                rest = int(np.searchsorted(s != large[0], True))  # leading rows of the large run
                own = v[:rest][np.diff(v[:rest], prepend=large[2]) != 0]
                yield batch_of(np.full(len(own), large[1]), own, np.full(len(own), 2 + (large[0] & 1)))
                large = (*large[:2], own[-1] if len(own) else large[2])
                s, v = s[rest:], v[rest:]
                if not len(s):
                    continue
                large = None
            sig, node = np.concatenate([sig, s]), np.concatenate([node, v])
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[new], node[new]
            last = int(np.searchsorted(sig, sig[-1]))
            yield batch_of(*meetings(sig[:last], node[:last]))
            sig, node = sig[last:], node[last:]
            if len(sig) > SMALL_MEETING:
                yield batch_of(*meetings(sig, node))
                large, sig, node = (sig[0], node[0], node[-1]), sig[:0], node[:0]
        yield batch_of(*meetings(sig, node))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows whose signature another node has, too. The last row waits for what comes after it."""
        sig, node, told = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            held = len(sig)
            sig, node = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((sig, "sig"), (node, "node")))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[new], node[new]
            same = sig[1:] == sig[:-1]
            meets = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            out = meets.copy()
            out[0] &= not (held and told)
            yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(sig[out] & 1)], ["node", "odd"])
            told = bool(meets[-1]) or (len(sig) == 1 and told)
            sig, node = sig[-1:], node[-1:]

    def linkable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, o, b, even, odd = (batch.column(c).to_numpy() for c in ("n", "o", "b", "even", "odd"))
            yield batch.filter(pa.array(can_link(n, o, b, even, odd, percent)))

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds whether a set's large meetings can be enough for a link, in the even and in the odd class."""
        for batch in batches:
            n, o, b, even, odd = (batch.column(c).to_numpy() for c in ("n", "o", "b", "large0", "large1"))
            none = np.zeros_like(even)
            crowds = [can_link(n, o, b, *counts, percent) for counts in ((even, none), (none, odd))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, crowds)], [*batch.schema.names, "crowd0", "crowd1"])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two sets whose large meetings are enough are in one crowd if any of these were of each other."""
        for batch in batches:
            c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            own = lambda name: np.where(c["kind"] == 1, c[f"{name}1"], c[f"{name}0"])  # noqa: E731, B023
            enough = lambda n: enough_meetings((c["na"], c["nb"]), (c["oa"], c["ba"], c["ob"], c["bb"]), c["kind"], n, percent)  # noqa: E731, B023
            apart = ~(own("crowda") & own("crowdb"))
            ok = enough(c["n"]) | (apart & enough(c["n"] + np.minimum(own("largea"), own("largeb"))))
            yield pa.RecordBatch.from_arrays([pa.array(c["a"][ok]), pa.array(c["b"][ok])], ["a", "b"])

    ordered = lambda df: df.repartition("sig").sortWithinPartitions("sig", "node")
    # One text of each set is enough; copies that the sketch lets pass are the same node.
    one_each = docs.sparkSession.sparkContext.broadcast(membership_sketch(sets.select(F.xxhash64("doc_id").alias("key")), "key"))
    counts = ordered(_segments(docs, shingle, percent, one_each)).mapInArrow(shared, "node long, odd long").groupBy("node").agg(
        F.count_if(F.col("odd") == 0).alias("even"), F.count_if(F.col("odd") == 1).alias("odd")
    )
    met_others = sets.select("node", "n", "o", "b", "doc_id").join(counts, "node")
    nodes = written(met_others.mapInArrow(linkable, met_others.schema), "jaccard-linkable")
    sketch = docs.sparkSession.sparkContext.broadcast(membership_sketch(nodes.select(F.xxhash64("doc_id").alias("key")), "key"))
    again = _segments(docs, shingle, percent, sketch)
    met = ordered(again).mapInArrow(meet, "a long, b long, kind long").where("a <> b OR kind > 1").groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("n"))
    met = written(met, "jaccard-meetings")
    large = met.where("kind > 1").groupBy(F.col("b").alias("node")).agg(*(F.sum(F.when(F.col("kind") == 2 + i, F.col("n")).otherwise(0)).alias(f"large{i}") for i in (0, 1)))
    judged = nodes.select("node", "n", "o", "b").join(large, "node", "left").fillna(0, ["large0", "large1"])
    judged = written(judged.mapInArrow(crowded, "node long, n long, o long, b long, large0 long, large1 long, crowd0 boolean, crowd1 boolean"), "jaccard-judged")
    kinds = {"n": "n{}", "o": "o{}", "b": "b{}", "large0": "large{}0", "large1": "large{}1", "crowd0": "crowd{}0", "crowd1": "crowd{}1"}
    side = lambda x: judged.select(F.col("node").alias(x), *(F.col(c).alias(to.format(x)) for c, to in kinds.items()))
    pairs = met.where("kind < 2").join(side("a"), "a").join(side("b"), "b").mapInArrow(filtered, "a long, b long").distinct()
    crowds = met.where("kind > 1").join(judged.where("crowd0 OR crowd1").select(F.col("node").alias("b"), "crowd0", "crowd1"), "b")
    crowds = crowds.where("(kind = 2 AND crowd0) OR (kind = 3 AND crowd1)").select("a", "b")
    return written(pairs, "jaccard-pairs"), crowds, nodes


def overlaps(grams: np.ndarray, owners: np.ndarray, n: int, split: int = 0) -> np.ndarray:
    """Overlaps of n sets with each other, or of the first ``split`` with the others: partial counts of fragments of the
    n-gram order, summed up."""
    order = np.lexsort((owners, grams))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    held = np.bincount(column)[column] if len(column) else column
    a, b = (split, n - split) if split else (n, n)
    total = np.zeros((a, b), np.float32)
    few = (held > 1) & (held <= FEW)
    c, o = column[few], owners[few]
    for step in range(1, FEW):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        left, right = o[same], o[same + step]
        if split:
            cross = (left < split) & (right >= split)
            left, right = left[cross], right[cross] - split
        total += np.bincount(left * b + right, minlength=a * b).reshape(a, b)
    if not split:
        total += total.T
    many = held > FEW
    c, o = column[many], owners[many]
    if len(c):
        c = np.cumsum(np.concatenate([np.zeros(1, np.int64), np.diff(c) != 0]))
        width = max(64, DENSE_CELLS // n)
        for start in range(0, int(c[-1]) + 1, width):
            lo, hi = np.searchsorted(c, [start, start + width])
            cells = np.zeros((n, width), np.float32)
            cells[o[lo:hi], c[lo:hi] - start] = 1
            total += cells[:a] @ cells[split:].T
    if not split:
        np.fill_diagonal(total, 0)
    return total


def forest(linked: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest index, other) of the components of a symmetric matrix of links, or with ``split`` of a rectangle
    whose columns are numbered from there."""
    a, b = np.nonzero(linked)
    b = b + split
    n = split + linked.shape[1]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    label = np.arange(n)
    while len(a):
        least = label.copy()
        np.minimum.at(least, a, label[b])
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(n))
    return label[moved], moved


def _members(described: DataFrame, sets: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, root (its candidate group), n, doc_id (of one text of it), hub (of the group)."""
    own = written(groups.join(sets.select("node", "n", "doc_id"), "node").join(nodes.select("node", (F.col("even") + F.col("odd")).alias("met")), "node", "left"), "jaccard-groups")
    hubs = own.groupBy("root").agg(F.max(F.struct(F.coalesce("met", F.lit(0)).alias("met"), "n", "node")).alias("h")).select("root", F.col("h.node").alias("hub"))
    return written(spread_join(own, hubs, "root", "node", "inner").select("node", "root", "n", "doc_id", "hub"), "jaccard-members")


def _fragments(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """node, fragment, grams: the segments, empty ones too, of the sets of ``members``."""
    sketch = docs.sparkSession.sparkContext.broadcast(membership_sketch(members.select(F.xxhash64("doc_id").alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            keep = in_sketch(sketch.value, batch.column("key").to_numpy())
            for part in slices(iter([batch.filter(pa.array(keep))])):
                grams, owners = shingle_sets(part.column("text"), shingle)
                sizes, node = set_hashes(grams, owners, part.num_rows)
                new = seen.first(node, sizes > 0)
                use = new[owners]
                grams, row = grams[use], (np.cumsum(new) - 1)[owners[use]]
                # Sets are ordered by hash, so that their segments follow each other.
                fragment = (grams >> np.uint64(32)) * np.uint64(FRAGMENTS) >> np.uint64(32)
                lengths = np.bincount(row * FRAGMENTS + fragment.astype(np.int64), minlength=int(new.sum()) * FRAGMENTS)
                columns = [pa.array(np.repeat(node[new], FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), int(new.sum()))), _lists(grams, lengths)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "fragment", "grams"])

    keyed = docs.select("text", F.xxhash64("doc_id").alias("key"))
    parts = keyed.mapInArrow(run, "node long, fragment int, grams array<long>")
    return written(parts.join(members.select("node", "root", "hub", "n"), "node"), "jaccard-segments")


def _summed() -> Column:
    """The sum of the fragments' partial counts. Several tasks may put out a set (repeated rows, null ids, false members of
    the sketch); each fragment counts once."""
    once = [F.coalesce(F.max(F.when(F.col("fragment") == i, F.col("shared"))), F.lit(0)) for i in range(FRAGMENTS)]
    return sum(once[1:], once[0])


def _hub_links(segments: DataFrame, percent: int) -> DataFrame:
    """node, root, n, linked: whether each set is linked with its group's hub (the hub is). Partial counts per fragment."""
    # Hub and fragment are one key: a large group is spread by its sets.
    key = F.xxhash64("root", "fragment").alias("key")
    hubs = segments.where("node = hub").groupBy(key).agg(F.first("grams").alias("theirs"), F.first("n").alias("m"))
    both = spread_join(segments.select(key, "root", "fragment", "node", "n", "grams"), hubs, "key", "node", "inner")
    partial = both.select("node", "root", "n", "m", "fragment", F.size(F.array_intersect("grams", "theirs")).alias("shared"))
    total = partial.groupBy("node", "root", "n").agg(F.max("m").alias("m"), _summed().alias("shared"))
    return total.select("node", "root", "n", (100 * F.col("shared") >= percent * (F.col("n") + F.col("m") - F.col("shared"))).alias("linked"))


def _pair_links(segments: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are links. Partial counts per fragment."""
    key = lambda node: F.xxhash64(node, "fragment").alias("key")
    own = segments.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    own = own.groupBy(key("node")).agg(F.first("grams").alias("ours"), F.first("n").alias("n"))
    theirs = segments.select(F.col("node").alias("b"), "fragment", F.col("n").alias("m"), F.col("grams").alias("theirs")).join(pairs, "b")
    both = spread_join(theirs.select(key("a"), "a", "b", "m", "fragment", "theirs"), own, "key", "b", "inner")
    partial = both.select("a", "b", "n", "m", "fragment", F.size(F.array_intersect("ours", "theirs")).alias("shared"))
    total = partial.groupBy("a", "b").agg(F.max("n").alias("n"), F.max("m").alias("m"), _summed().alias("shared"))
    return total.where(100 * F.col("shared") >= percent * (F.col("n") + F.col("m") - F.col("shared"))).select("a", "b")


def _crowd_links(segments: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), in each crowd (root) of ``settled``, of sets that aren't linked with their hub: a spanning forest for
    each pair of blocks."""
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK_SETS), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_GRAMS)).cast("int")
    per_group = settled.groupBy("root").agg(blocks(~F.col("linked")).alias("opens"), blocks(F.col("linked")).alias("others")).where("opens > 0")
    first, many = F.when(F.col("linked"), F.col("opens")).otherwise(0), F.when(F.col("linked"), F.col("others")).otherwise(F.col("opens"))
    block = (first + F.pmod(F.xxhash64("node"), F.greatest(many, F.lit(1)))).cast("int")
    placed = spread_join(settled, per_group, "root", "node", "inner").select("node", "root", "linked", "opens", "others", block.alias("block"))
    # Blocks of open sets meet all blocks, the others only those of open sets.
    last = F.when(F.col("linked"), F.col("opens")).otherwise(F.col("opens") + F.col("others")) - 1
    spread = segments.select("node", "fragment", "n", "grams").join(placed, "node").withColumn("x", F.explode(F.sequence(F.lit(0), last)))
    by_pair = spread.select("root", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "fragment", "block", "node", "n", "grams")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts of a fragment, for each pair of blocks."""
        key, held = None, []

        def finish() -> pa.RecordBatch:
            root, i, j, fragment = key
            rows = {node: (block, n, grams) for block, node, n, grams in held}
            blocks = np.array([b for b, _, _ in rows.values()])
            split = int((blocks == i).sum()) if i != j else 0
            sizes = np.array([len(g) for _, _, g in rows.values()])
            grams = np.concatenate([g for _, _, g in rows.values()])
            if i != j and split in (0, len(blocks)):
                partial = b""
            else:
                partial = overlaps(grams.astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes), len(sizes), split).astype(np.int32).tobytes()
            values = [[root], [i], [j], [split], [list(rows)], [[n for _, n, _ in rows.values()]], [partial]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "fragment")), strict=True))
            block, node, n = (batch.column(c).to_pylist() for c in ("block", "node", "n"))
            column = batch.column("grams")
            for at, k in enumerate(keys):
                if k != key:
                    if len(held) > 1:
                        yield finish()
                    key, held = k, []
                held.append((block[at], node[at], n[at], column[at].values.to_numpy()))
        if len(held) > 1:
            yield finish()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of the partial counts; pairs over the threshold become a forest."""
        key, nodes, sizes, split, counts = None, [], [], 0, None

        def finish() -> pa.RecordBatch:
            n = np.array(sizes, np.int64)
            rows, columns = (n[:split], n[split:]) if split else (n, n)
            shared = counts.reshape(len(rows), len(columns)).astype(np.int64)
            over = (shared > 0) & (100 * shared >= percent * (rows[:, None] + columns[None, :] - shared))
            a, b = forest(over, split)
            node = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["counts"], np.int32)
                if (k := (row["root"], row["i"], row["j"])) != key:
                    if key is not None and len(counts):
                        yield finish()
                    key, nodes, sizes, split, counts = k, row["nodes"], row["sizes"], row["split"], own.copy()
                else:
                    counts += own
        if key is not None and len(counts):
            yield finish()

    names = ["root", "i", "j", "split", "nodes", "sizes", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    keyed = by_pair.repartition("root", "i", "j", "fragment").sortWithinPartitions("root", "i", "j", "fragment", "block", "node")
    partial = keyed.mapInArrow(count, "root long, i int, j int, split int, nodes array<long>, sizes array<long>, counts binary")
    return partial.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(total, "a long, b long")


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for ``docs`` (doc_id, text): sets link at a similarity of ``percent`` / 100."""
    with shuffle_files_dropped(docs.sparkSession):
        return _components(docs, shingle, percent)


def _components(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    described = written(_described(docs, shingle, percent), "jaccard-sets")
    sets = written(
        described.where("node IS NOT NULL").groupBy("node").agg(
            F.max("n_shingles").alias("n"), F.max("e_own").alias("o"), F.max("e_below").alias("b"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
        ),
        "jaccard-nodes",
    )
    pairs, edges, nodes = _candidates(docs, sets, shingle, percent)
    members = _members(described, sets, nodes, components(pairs.unionByName(edges)))
    segments = _fragments(docs, members, shingle)
    settled = written(_hub_links(segments, percent), "jaccard-hubs")
    hub_of = members.where("node <> hub").select("node", F.col("hub").alias("a"))
    crowds = components(edges).withColumnRenamed("root", "crowd")
    states = written(settled.join(members.select("node", "hub"), "node").join(crowds, "node", "left").select("node", "n", "linked", (F.col("node") == F.col("hub")).alias("is_hub"), "crowd"), "jaccard-states")
    state = lambda x: states.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("linked", "is_hub", "crowd")))
    # What two links with the hub, a count against it or the blocks of a crowd say of a pair needn't be asked again.
    left = pairs.join(state("a"), "a").join(state("b"), "b").where("NOT (linked_a AND linked_b) AND NOT is_hub_a AND NOT is_hub_b AND NOT coalesce(crowd_a = crowd_b, false)")
    left = written(left.select("a", "b"), "jaccard-open-pairs")
    in_crowds = states.where("crowd IS NOT NULL").select("node", F.col("crowd").alias("root"), "n", "linked")
    links = settled.where("linked").join(hub_of, "node").select("a", F.col("node").alias("b"))
    roots = components(links.unionByName(_pair_links(segments, left, percent)).unionByName(_crowd_links(segments, in_crowds, percent)))
    # The smallest id of each component, for the sets that need one.
    named = written(sets.select("node", "doc_id", "copies").join(roots, "node", "left").where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "node")), "jaccard-roots")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = written(spread_join(named, least, "root", "node", "inner").select("node", "component_id", F.lit(True).alias("named")), "jaccard-components")
    out = spread_join(described.select("doc_id", "n_shingles", "node"), component, "node", "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i:i + {SHINGLE} - 1], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM words
), sizes AS (
  SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN grams USING (doc_id) GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, r.component_id
FROM sizes s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
