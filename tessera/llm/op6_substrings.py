"""Substring deduplication: suffix automata of reference shards, documents streamed for matching statistics.

A word goes if a window of ``window`` consecutive words covers it whose sequence also starts in a document with a
smaller id. Three steps:

1. Candidates. Each window has an anchor, the least hash among its 10-word grams; only windows whose anchor occurs in
   two documents can repeat, and of those the ones whose own hash does are found by a shuffle. Windows with an anchor of
   very many documents are summed up before that, and their documents dealt over tasks. Runs of repeated windows become
   (document, stretch, first document, stretch there).
2. Matching. The stretches of first documents are the reference, cut into shards of bounded size. A shard's automaton
   is sent to all tasks that stream documents with stretches in it (several, if many documents have), and knows for
   each state the smallest document in which its words occur. Matching statistics over a streamed stretch give the
   spans of at least ``window`` words that a smaller document holds; hashes decide nothing here.
3. The spans are removed, and the rest is joined by single spaces.

Defined results: a null text has no words; a null id matches nothing and keeps all words; repeated rows, and rows that
share an id, don't take words from each other, but each loses what smaller ids hold; an empty table gives no rows;
other columns are ignored. Texts are taken in slices of about 1 MB, a longer one is held whole, with temporaries of
some 12 times its size; what a matching task holds is one shard's automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import in_sketch, membership_sketch, only, spread_join, written
from tessera.llm._words import gram_hashes, slices, text_buffer, word_hashes, word_spans

WINDOW = 50
ANCHOR_GRAM = 10
PIECE = 8192
SHARD_WORDS = 100_000
STREAM_WORDS = 1_000_000
#: An anchor that so many documents have is frequent.
FREQUENT = 1000
#: The bitmap of shared anchors has eight places for each, within these bounds (128 KB to 32 MB). Beyond what it is made
#: for it lets more windows pass, never fewer.
ANCHOR_BITS = (20, 28)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _anchored(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor, row and number of the first word in its row of every window."""
    buf, offs = text_buffer(column)
    s, e, rows = word_spans(buf, offs)
    words = word_hashes(buf, s, e)
    hashes, at = gram_hashes(words, rows, window)
    if not len(at):
        return hashes, hashes.astype(np.int64), at, at
    gram = min(ANCHOR_GRAM, window)
    every, _ = gram_hashes(words, np.zeros(len(words), np.int8), gram)  # of a window, all are in one row
    anchors = _least(every, window - gram + 1)[at]
    base = np.searchsorted(rows, np.arange(len(column)))
    return hashes, anchors.astype(np.int64), rows[at], at - base[rows[at]]


def _shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, anchors, rows, _ = _anchored(batch.column("text"), window)
            new = np.ones(len(rows), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(anchors[new]), batch.column("doc_id").take(pa.array(rows[new]))], ["h", "doc_id"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "h long, doc_id long")
    return rows.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select("h", "n")


def _repeats(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, spot, first_doc, first_spot of each window that a smaller document has; spot: text hash << 32 | word."""
    anchors = written(_shared_anchors(docs, window), "anchors")
    bits = min(max((8 * anchors.count()).bit_length(), ANCHOR_BITS[0]), ANCHOR_BITS[1])
    sketch, frequent = (docs.sparkSession.sparkContext.broadcast(membership_sketch(x, "h", bits)) for x in (anchors, anchors.where(F.col("n") > FREQUENT)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different window of a text, with all its spots: texts that repeat themselves make few rows."""
        for batch in slices(batches):
            hashes, anchors, rows, at = _anchored(batch.column("text"), window)
            keep = np.flatnonzero(in_sketch(sketch.value, anchors, bits))
            hashes, rows, at, often = hashes[keep].astype(np.int64), rows[keep], at[keep], in_sketch(frequent.value, anchors[keep], bits)
            order = np.lexsort((at, hashes, rows))
            hashes, rows, at, often = hashes[order], rows[order], at[order], often[order]
            new = np.ones(len(rows), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
            first = np.flatnonzero(new)
            spot = (batch.column("th").to_numpy()[rows] << 32) | at
            offsets = np.append(first, len(rows)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[first]), batch.column("doc_id").take(pa.array(rows[first])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(spot)), pa.array(often[first])],
                ["w", "doc_id", "spots", "frequent"],
            )

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by window, document and spots."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w, doc = (batch.column(c).to_numpy() for c in ("w", "doc_id"))
            spots, lens = batch.column("spots").flatten().to_numpy(), pc.list_value_length(batch.column("spots")).to_numpy()
            own = spots[np.cumsum(lens) - lens]
            new = np.ones(len(w), bool)
            new[1:] = w[1:] != w[:-1]
            new[0] = last is None or w[0] != last[0]
            at = np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))
            held = last or (0, 0, 0)
            first_doc = np.where(at >= 0, doc[np.maximum(at, 0)], held[1])
            first_spot = np.where(at >= 0, own[np.maximum(at, 0)], held[2])
            last = (w[-1], first_doc[-1], first_spot[-1])
            each = np.repeat(np.arange(len(w)), lens)
            hit = (doc > first_doc)[each]
            each = each[hit]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[each], spots[hit], first_doc[each], first_spot[each])], ["doc_id", "spot", "first_doc", "first_spot"])

    rows = written(docs.where("doc_id IS NOT NULL").mapInArrow(windows, "w long, doc_id long, spots array<long>, frequent boolean"), "windows")
    ordered = rows.where("NOT frequent").select("w", "doc_id", "spots").repartition("w").sortWithinPartitions("w", "doc_id", "spots")
    rare = ordered.mapInArrow(firsts, "doc_id long, spot long, first_doc long, first_spot long")
    hot = rows.where("frequent")
    first = hot.groupBy("w").agg(F.min(F.struct("doc_id", F.col("spots")[0].alias("spot"))).alias("f"), F.max("doc_id").alias("b")).where("f.doc_id < b")
    later = spread_join(hot, first.select("w", F.col("f.doc_id").alias("first_doc"), F.col("f.spot").alias("first_spot")), "w", "doc_id").where("doc_id > first_doc")
    return rare.unionByName(later.select("doc_id", F.explode("spots").alias("spot"), "first_doc", "first_spot"))


def _stretches(repeats: DataFrame) -> DataFrame:
    """Runs of n repeated windows whose first occurrences are in the same piece of the same text, with the span of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, spot, fdoc, fspot = (batch.column(c).to_numpy() for c in ("doc_id", "spot", "first_doc", "first_spot"))
            other = np.ones(len(doc), bool)  # repeated rows have the same spots
            other[1:] = (doc[1:] != doc[:-1]) | (spot[1:] != spot[:-1])
            doc, spot, fdoc, fspot = doc[other], spot[other], fdoc[other], fspot[other]
            new = np.ones(len(doc), bool)
            piece = (fspot >> 32 << 32) + (fspot & 0xFFFFFFFF) // PIECE
            new[1:] = (doc[1:] != doc[:-1]) | (spot[1:] != spot[:-1] + 1) | (fdoc[1:] != fdoc[:-1]) | (piece[1:] != piece[:-1])
            at = np.flatnonzero(new)
            n, low = np.diff(np.append(at, len(doc))), np.minimum.reduceat(fspot, at)
            span = np.maximum.reduceat(fspot, at) - low + 1
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], spot[at], n, fdoc[at], low, span)], ["doc_id", "spot", "n", "first_doc", "first_spot", "span"])

    text = F.call_function("shiftright", F.col("spot"), F.lit(32))
    ordered = repeats.withColumn("t", text).repartition("doc_id", "t").sortWithinPartitions("doc_id", "spot").drop("t")
    return ordered.mapInArrow(run, "doc_id long, spot long, n long, first_doc long, first_spot long, span long")


class SuffixAutomaton:
    """Of several word sequences; ``least`` is the smallest owner of an occurrence of a state's words."""

    def __init__(self, window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]
        self.last, self.marks = 0, 0

    def add(self, words: list[bytes], owner: int) -> None:
        ids = self.ids
        for w in words:
            self._extend(ids.setdefault(w, len(ids)), owner)
        self.marks -= 1
        self._extend(self.marks, owner)  # a mark of its own ends each sequence

    def _extend(self, c: int, owner: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        p, cur = self.last, len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        self.least.append(owner)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.least.append(1 << 63)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def finish(self) -> None:
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        link, length, least = self.link, self.length, self.least
        for v in reversed(order[1:]):
            if least[v] < least[link[v]]:
                least[link[v]] = least[v]
        self.top = [0] * len(link)  # the state of the last ``window`` words of a longer match
        for v in order[1:]:
            self.top[v] = self.top[link[v]] if length[link[v]] >= self.window else v

    def spans(self, words: list[bytes], owner: int) -> list[tuple[int, int]]:
        """Maximal spans of words covered by windows that occur with an owner below ``owner``."""
        nxt, link, length, least, top, window = self.next, self.link, self.length, self.least, self.top, self.window
        out: list[tuple[int, int]] = []
        v = matched = 0
        for i, c in enumerate(map(self.ids.get, words), 1):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                matched += 1
            if matched >= window and least[top[v]] < owner:
                if out and out[-1][1] >= i - window:
                    out[-1] = (out[-1][0], i)
                else:
                    out.append((i - window, i))
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.hash("text").cast("long").alias("th"), F.xxhash64("doc_id").alias("key"))


def covered_spans(docs: DataFrame, window: int = WINDOW, bits: int = 25) -> DataFrame:
    """doc_id, th (text hash), spans (array of start, stop in words) of the documents that lose words."""
    spark, keyed = docs.sparkSession, _keyed(docs)
    runs = written(_stretches(_repeats(keyed, window)), "repeated-stretches")
    high, low = (lambda c: F.call_function("shiftright", F.col(c), F.lit(32))), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    placed = runs.select("doc_id", high("spot").alias("th"), low("spot").alias("lo"), "n", "first_doc", high("first_spot").alias("fth"), low("first_spot").alias("flo"), "span")
    placed = placed.withColumn("piece", F.floor(F.col("flo") / PIECE))
    reference = written(
        placed.groupBy("first_doc", "fth", "piece").agg(F.min("flo").alias("lo"), (F.max(F.col("flo") + F.col("span")) - F.min("flo")).alias("n")), "reference"
    )
    words = reference.agg(F.coalesce(F.sum(F.col("n") + window), F.lit(0))).first()[0]
    shard = lambda *key: F.pmod(F.xxhash64(*key), F.lit(int(words // SHARD_WORDS + 1)))
    streams = placed.withColumn("shard", shard("first_doc", "fth", "piece"))
    salts = streams.groupBy("shard").agg(F.ceil(F.sum(F.col("n") + window) / STREAM_WORDS).alias("salts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    texts = reference.withColumn("shard", shard("first_doc", "fth", "piece")).join(salts, "shard")
    texts = texts.select(F.col("first_doc").alias("doc_id"), F.col("fth").alias("th"), "shard", every.alias("salt"), F.lit(0).alias("kind"), "lo", "n")
    streams = streams.join(salts, "shard").select("doc_id", "th", "shard", F.pmod(F.xxhash64("doc_id", "lo"), "salts").alias("salt"), F.lit(1).alias("kind"), "lo", "n")
    needed = texts.unionByName(streams).groupBy("doc_id", "th").agg(F.collect_list(F.struct("shard", "salt", "kind", "lo", "n")).alias("cuts"))
    ids = placed.select("doc_id").union(placed.select("first_doc"))
    sketch = spark.sparkContext.broadcast(membership_sketch(ids.select(F.xxhash64("doc_id").alias("key")), "key", bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "salt", "kind", "doc_id", "th", "lo", "words"]
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, th, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "cuts")), strict=True):
                own = text.encode().split()
                for c in cuts:
                    out.append((c["shard"], c["salt"], c["kind"], doc, th, c["lo"], b" ".join(own[c["lo"] : c["lo"] + c["n"] + window - 1])))
            columns = zip(*out, strict=True) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            yield from slices(iter([whole]), "words")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by shard and salt, a shard's reference before the streams."""
        at, automaton, ready = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for shard_id, salt, kind, doc, th, lo, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard_id, salt) != at:
                    at, automaton, ready = (shard_id, salt), SuffixAutomaton(window), False
                if kind == 0:
                    automaton.add(text.split(), doc)
                    continue
                if not ready:
                    automaton.finish()
                    ready = True
                out += [(doc, th, lo + a, lo + b) for a, b in automaton.spans(text.split(), doc)]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "th", "start", "stop"])

    cuts = only(keyed, sketch, True, bits).drop("key").join(needed, ["doc_id", "th"]).mapInArrow(cut, "shard long, salt long, kind int, doc_id long, th long, lo long, words binary")
    ordered = cuts.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "doc_id", "th", "lo")
    spans = ordered.mapInArrow(match, "doc_id long, th long, start long, stop long")
    return spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def remove_substrings(docs: DataFrame, window: int = WINDOW, texts: bool = True, bits: int = 25) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if ``texts``, the kept text of each row of ``docs`` (doc_id, text)."""
    spans = written(covered_spans(docs, window, bits), "covered-spans")
    sketch = docs.sparkSession.sparkContext.broadcast(membership_sketch(spans.select(F.xxhash64("doc_id").alias("key")), "key", bits))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept, at = [], 0
                for span in found or ():
                    kept += words[at : max(at, span["start"])]
                    at = max(at, span["stop"])
                kept = kept + words[at:] if at else words
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None))
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new[: len(names) - 1]], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    keyed = _keyed(docs)
    none = F.lit(None).cast("array<struct<start:long,stop:long>>")
    others = only(keyed, sketch, False, bits).select("doc_id", "text", none.alias("spans"))
    losing = only(keyed, sketch, True, bits).join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return others.mapInArrow(run, schema).unionByName(losing.mapInArrow(run, schema))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_substrings(docs, texts=False)


SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words WHERE len(w) >= {WINDOW})
), firsts AS (
  SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM windows JOIN firsts USING (h) CROSS JOIN range(0, {WINDOW}) r(k) WHERE first_id < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(len(w.w), 0) AS BIGINT) AS n_words, CAST(coalesce(len(w.w), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
