"""Token counts of byte-level BPE vocabularies by heap-and-linked-list merging.

A piece starts as its byte symbols in a linked list; a heap yields the adjacent pair of lowest rank (leftmost among
equals), which is merged and its new neighbours pushed. The token count is the number of initial symbols minus the
merges, so no identifiers are made. Pieces come from the vocabulary's own pre-tokeniser pattern; the counts of pieces
that repeat are kept in a bounded table per worker.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings in a text are one token each, as the
library does by default; symbols without an entry in the vocabulary count as nothing, like there; null and repeated ids
pass through; empty tables give no rows. Very long pieces merge in O(n log n).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._words import slices

LIMIT = 1024
CACHED_PIECES = 400_000
CACHED_LENGTH = 64
VOCABULARY = "byte_bpe_50k.json"
#: The byte-level pre-tokeniser's published pattern (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class BytePairCounter:
    """Counts tokens by the ranks of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser is needed")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.vocabulary = model["vocab"] if model.get("ignore_merges") else {}
        self.symbols = _byte_symbols()
        self.known = {s for s in self.symbols if s in model["vocab"]}
        self.prefix = pre.get("add_prefix_space", False)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.kept: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Initial symbols minus merges of one piece."""
        symbols = [self.symbols[b] for b in piece.encode("utf-8")]
        if self.vocabulary and "".join(symbols) in self.vocabulary:
            return 1
        symbols = [s for s in symbols if s in self.known]
        n = len(symbols)
        if n < 2:
            return n
        ranks, after, before = self.ranks, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def _plain(self, text: str) -> int:
        total, kept = 0, self.kept
        if self.prefix and text and not text[0].isspace():
            text = " " + text
        for m in self.pieces.findall(text):
            n = kept.get(m)
            if n is None:
                n = self.piece(m)
                if len(m) <= CACHED_LENGTH:
                    if len(kept) >= CACHED_PIECES:
                        kept.clear()
                    kept[m] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


@lru_cache(maxsize=2)
def _counter(path: str) -> BytePairCounter:
    return BytePairCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``docs`` (text, more columns) with n_bytes, n_tokens and over_limit. ``path``: the same on all workers."""
    plain = docs.drop("n_tokens", "n_bytes", "over_limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches):
            counts = [counter.count(t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_tokens"])

    schema = T.StructType([*plain.schema.fields, T.StructField("n_tokens", T.LongType())])
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return plain.mapInArrow(run, schema).withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
