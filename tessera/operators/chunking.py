"""Chunkers: fixed windows, header sections, and the structure chunker with merging of short pieces."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.functions.text import BLANKS, trimmed

MAX_SIZE, MIN_SIZE = 800, 100
#: Marks that a long paragraph may be cut after (fixed values).
SENTENCE_ENDS = "。\n；"


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("chunk size must be positive and overlap in [0, size)")


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Trimmed windows of ``size`` characters, ``size - overlap`` apart, up to the first that reaches the end.

    Blank windows are dropped before they are numbered; empty text or size 0 gives none.
    """
    step = max(size - overlap, 1)
    rest = size - step
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")

    def window(own: Column, i: Column) -> Column:
        """A piece of ``step`` characters with the ``rest`` of the window from those after it."""
        more = F.concat_ws("", F.slice(own, i + 2, F.lit(-(-rest // step)))) if rest > step else F.coalesce(F.get(own, i + 1), F.lit(""))
        return trimmed(F.concat(F.get(own, i), F.left(more, F.lit(rest))) if rest else F.get(own, i))

    # The text is cut once, by the pattern; a lambda's variable holds the pieces, so no window cuts or counts again.
    cut = F.flatten(F.transform(F.array(pieces), lambda own: F.transform(F.sequence(F.lit(0), last), lambda i: window(own, i))))
    kept = F.filter(cut, lambda c: c != "")
    none = F.array().cast("array<string>")
    return F.when((F.length(text) > 0) & F.lit(size > 0), kept).otherwise(none)


def chunk_fixed(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", strict: bool = True) -> DataFrame:
    """key, chunk_index, chunk_id (``key:index``), content. ``strict`` refuses an overlap of ``size`` or more."""
    if strict:
        check_chunking(size, overlap)
    each = docs.select(key, F.posexplode(fixed_windows(F.col("text"), size, overlap)).alias("chunk_index", "content"))
    return each.select(key, "chunk_index", F.concat_ws(":", key, "chunk_index").alias("chunk_id"), "content")


def chunk_sections(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """Fixed windows without overlap inside sections; a section starts at a line whose first visible character is #."""
    check_chunking(size, 0)
    lines = F.regexp_replace("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")
    sections = F.split(lines, rf"(?dm)^(?=[{BLANKS[1:-1]}&&[^\n]]*#)")
    pieces = F.flatten(F.transform(sections, lambda s: fixed_windows(trimmed(s), size, 0)))
    return docs.select(key, F.posexplode(pieces).alias("chunk_index", "content"))


def section_starts(text: str) -> list[int]:
    """Where the lines begin that open a section; the text's start is one of these only if it does."""
    return [m.start() for m in re.finditer(r"^[^\S\n]*#", text, re.MULTILINE)]


def header_sections(text: str) -> list[tuple[str, str]]:
    """(header, body) pairs; a section without header needs a body that isn't blank. Lines end with a line feed each."""
    text = text.replace("\r\n", "\n")
    if not text.endswith("\n"):
        text += "\n"
    at = section_starts(text)
    cuts = [*at, len(text)]
    found = [("", text[: cuts[0]])] if text[: cuts[0]].strip() else []
    for a, b in zip(at, cuts[1:], strict=True):
        header, _, body = text[a:b].partition("\n")
        found.append((header.lstrip(), body))
    return found


def sentence_cuts(text: str, most: int) -> list[int]:
    """Cut points no more than ``most`` apart: after the last sentence end in a piece's second half, or at full length."""
    ends = [m.end() for m in re.finditer(f"[{SENTENCE_ENDS}]", text)]
    cuts = [0]
    while len(text) - cuts[-1] > most:
        here = bisect_right(ends, cuts[-1] + most) - 1
        cuts.append(ends[here] if here >= 0 and ends[here] > cuts[-1] + most // 2 else cuts[-1] + most)
    return [*cuts, len(text)]


def paragraph_packs(lengths: list[int], most: int) -> list[int]:
    """Where packs of paragraphs begin, each filled while the next paragraph fits into ``most``, two separators counted."""
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.array(lengths, np.int64) + 2)])
    with_own = before[:-1] + np.array(lengths, np.int64)
    packs = [0]
    while (stop := max(packs[-1] + 1, int(np.searchsorted(with_own, most + before[packs[-1]], side="right")))) < len(lengths):
        packs.append(stop)
    return packs


def split_section(text: str, most: int, least: int) -> list[str]:
    """A long section in pieces: its only paragraph cut at sentence ends, or several packed; a short last pack joins the one before."""
    paragraphs = [p for p in text.split("\n\n") if p.strip()]
    if len(paragraphs) < 2:
        cuts = sentence_cuts(text, most)
        return [text[a:b].strip() for a, b in zip(cuts, cuts[1:])]
    at = [*paragraph_packs([len(p) for p in paragraphs], most), len(paragraphs)]
    packs = ["\n\n".join(paragraphs[a:b]).strip() for a, b in zip(at, at[1:])]
    if len(packs) > 1 and len(packs[-1]) < least:
        packs[-2:] = ["\n\n".join(packs[-2:])]
    return packs


def structure_pieces(text: str, most: int = MAX_SIZE, least: int = MIN_SIZE) -> list[tuple[str, str]]:
    """(section, content) of one text: sections kept whole up to ``most``, long ones split, short ones joined on.

    A piece shorter than ``least`` is appended to the chunk before it, which may grow beyond ``most`` by that and keeps
    its section; only a first chunk may be short.
    """
    pieces = []
    for header, body in header_sections(text):
        whole = f"{header}\n{body}" if header else body
        split = [whole] if len(whole.strip()) <= most else split_section(whole, most, least)
        pieces += [(header.lstrip("#").strip(), p) for p in map(str.strip, split) if p]
    begins = [i for i, (_, p) in enumerate(pieces) if i == 0 or len(p) >= least]
    return [(pieces[a][0], "\n\n".join(p for _, p in pieces[a:b])) for a, b in zip(begins, [*begins, len(pieces)][1:], strict=True)]


def chunk_structure(docs: DataFrame, most: int = MAX_SIZE, least: int = MIN_SIZE, key: str = "doc_id", cut: Callable = structure_pieces) -> DataFrame:
    """key, position, section, content; ``cut`` may be any other function from a text to (section, content) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, s, c) for k, t in zip(*(batch.column(x).to_pylist() for x in (key, "text")), strict=True) for i, (s, c) in enumerate(cut(t or "", most, least))]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (batch.schema.field(key).type, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [key, "position", "section", "content"])

    fields = [T.StructField("position", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("content", T.StringType())]
    return docs.select(key, "text").mapInArrow(run, T.StructType([docs.schema[key], *fields]))


def chunk_paragraphs(docs: DataFrame, most: int = MAX_SIZE, key: str = "doc_id") -> DataFrame:
    return chunk_structure(docs, most, 50, key)


def representative_texts(docs: DataFrame, count: int = 32, key: str = "doc_id") -> DataFrame:
    """``count`` texts: the paragraphs of 20 characters or more in document order, cycled, cut to 500 characters."""
    parts = docs.select(key, F.posexplode(F.split("text", "\n\n")).alias("at", "part")).select(key, "at", trimmed(F.col("part")).alias("part"))
    # Only the first ``count`` paragraphs can be picked, so a top-k replaces a numbering of all.
    first = parts.where(F.length("part") >= 20).orderBy(key, "at").limit(count)
    numbered = first.select(F.row_number().over(W.orderBy(key, "at")).alias("i"), "part")
    n = numbered.agg(F.count(F.lit(1)).alias("n"))
    wanted = docs.sparkSession.range(count).crossJoin(n)
    size = F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error("no representative texts").cast("long"))
    return wanted.select("id", (F.col("id") % size + 1).alias("i")).join(numbered, "i").select(F.col("id").alias("text_index"), F.substring("part", 1, 500).alias("text"))
