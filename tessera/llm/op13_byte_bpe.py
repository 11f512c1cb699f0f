"""Byte-level BPE encoding and decoding with the tiktoken library and a local file of ranks.

A text is encoded match by match of the vocabulary's pre-tokeniser pattern, without special tokens. The library's
regular expression gives up on runs of blanks of some hundred thousand characters, so a long text is cut at safe
boundaries first: places where every match of the pattern ends, whatever stands around. Between two of these a run of
blanks is one match and is encoded as a piece; anything else is left to the library. Ids are decoded to raw bytes, which
need not be UTF-8.

Defined results: null text counts as empty, empty text has no ids; ids that are null, hold a null or aren't in the
vocabulary decode to null; null and repeated rows pass through; an existing column of the result's name is replaced;
empty tables give no rows. A text is encoded whole, whatever its length, in pieces of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._words import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Texts with more characters are cut into parts of about so many.
LONG = 1 << 15
#: No match of the pattern crosses these places: a blank after another character, the last of several blanks before
#: another character, and changes between ASCII letters, digits and marks. An apostrophe may be part of what follows it.
BOUNDARY = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{White_Space})(?=\p{White_Space}\P{White_Space})"
    r"|(?<=[A-Za-z])(?=[0-9!-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])"
)
BLANK = regex.compile(r"\p{White_Space}+")


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoder for a file of base64 tokens with their ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, long: int = LONG) -> Iterator[str]:
    """``text`` cut at safe boundaries: parts of less than twice ``long`` characters, and longer runs without a boundary."""
    at = 0
    while len(text) - at > long:
        found = BOUNDARY.search(text, at + long)
        stop = found.start() if found else len(text)
        if stop - at >= 2 * long:  # a run without a boundary; what stands before it is a part of its own
            last = at
            for m in BOUNDARY.finditer(text, at + 1):
                if m.start() > at + long:
                    break
                last = m.start()
            if last > at:
                yield text[at:last]
            at = last
        yield text[at:stop]
        at = stop
    yield text[at:]


def encoded(encoder: tiktoken.Encoding, text: str, long: int = LONG) -> list[int]:
    if len(text) <= long:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    for part in parts(text, long):
        whole = len(part) > long and BLANK.fullmatch(part)
        ids += encoder._encode_single_piece(part) if whole else encoder.encode_ordinary(part)
    return ids


def _encoder(path: str, pattern: str, column: str, into: str, packed: bool) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path, pattern)
        for batch in slices(batches, column):
            ids = [np.array(encoded(encoder, t) if t else [], "<u4") for t in batch.column(column).to_pylist()]
            kind = pa.binary() if packed else pa.list_(pa.int32())
            yield _with(batch, into, pa.array([x.tobytes() for x in ids] if packed else [x.astype(np.int32) for x in ids], kind))

    return run


def _decoder(path: str, pattern: str, column: str, into: str) -> Batches:
    def raw(encoder: tiktoken.Encoding, ids: bytes | list[int | None] | None) -> bytes | None:
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, "<u4").tolist() if len(ids) % 4 == 0 else None
        try:
            return None if ids is None or None in ids else encoder.decode_bytes(ids)
        except (KeyError, OverflowError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(path, pattern)
        for batch in batches:
            yield _with(batch, into, pa.array([raw(encoder, ids) for ids in batch.column(column).to_pylist()], pa.binary()))

    return run


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), values], [*names, name])


def _schema(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in docs.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", into: str = "ids", packed: bool = False) -> DataFrame:
    """``docs`` with ``into``, an array of token ids, or ``packed`` as little-endian unsigned 32-bit integers.

    ``path`` is the same on all workers.
    """
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return docs.mapInArrow(_encoder(path, pattern, column, into, packed), _schema(docs, into, kind))


def decode(rows: DataFrame, path: str, pattern: str, column: str = "ids", into: str = "bytes") -> DataFrame:
    """``rows`` with ``into``, the bytes that the ids in ``column``, an array or packed, stand for."""
    return rows.mapInArrow(_decoder(path, pattern, column, into), _schema(rows, into, T.BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (text, more columns) with the packed ``ids`` and the ``bytes`` that they decode to instead of the text, in one pass."""
    to, back = _encoder(path, pattern, "text", "ids", True), _decoder(path, pattern, "ids", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from back(b.drop_columns(["text"]) for b in to(batches))

    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in ("text", "ids", "bytes")), T.StructField("ids", T.BinaryType()), T.StructField("bytes", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
