"""Words and word windows of Arrow text columns as 64-bit hashes, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of characters other than these.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: So many bytes of text are taken at a time, and so many are hashed at a time.
_PIECE = 1 << 20
_HASHED = 1 << 17
_Q = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over all output bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


_UP, _DOWN = _powers(_Q, _HASHED), _powers(pow(_Q, -1, 1 << 64), _HASHED)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = _PIECE) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text in each is below ``limit`` bytes or is that of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_buffer(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty, A-Z may be lower-cased."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(offs) else np.zeros(0, np.uint8)
    return (_LOWER[raw] if lower else raw), offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separators[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, last = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of a running sum over pieces of bounded size."""
    out = np.zeros(len(s), np.uint64)
    i = 0
    while i < len(s):
        start = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, start + _HASHED, side="right")))
        values = _BYTES[buf[start : int(e[j - 1])]]
        values *= _UP[: len(values)] if len(values) <= _HASHED else _powers(_Q, len(values))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        at, own = s[i:j] - start, e[i:j] - s[i:j]
        # Dividing by the power at its start, which is inside the table, makes a word's value independent of its place.
        out[i:j] = mix64((sums[at + own] - sums[at]) * _DOWN[at] + own.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of n consecutive words of one row."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    if n <= 16:
        acc = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):
            acc = acc * np.uint64(_Q) + words[j : len(words) - n + 1 + j]
        return mix64(acc[at] ^ np.uint64(n)), at
    power = np.cumprod(np.full(len(words), _Q, np.uint64))
    back = np.cumprod(np.full(len(words), pow(_Q, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power)])
    return mix64((sums[at + n] - sums[at]) * back[at] ^ np.uint64(n)), at
