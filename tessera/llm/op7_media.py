"""Media columns: WAV stored losslessly in a binary column, read back by the wave module, spectral-peak fingerprints.

``store_wav`` turns bytes into a mono WAV of unsigned 8-bit samples; ``wav_features`` reads such a column again, takes
short-time Fourier transforms with a hop of a quarter of a frame, finds each frame's PEAKS strongest peaks and pairs them
with those of the next FAN_OUT frames. The fingerprint is an array of (time, frequency, later frequency, distance) codes
in time order. A frame has FRAME samples, or a quarter of the payload if that is less; both ends are filled up with the
middle value, so that each sample is near the middle of a frame; all spectra have the bins of FRAME samples.

Defined results: null text counts as empty, and a payload is padded with zero bytes to a positive multiple of 64;
silent frames have no peak; very long payloads are read and transformed in blocks; equal texts give equal values;
null and repeated ids pass through, empty tables give no rows, other columns stay unless a computed one has that name.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._words import slices

RATE = 8000
FRAME = 512
BLOCK_FRAMES = 4096
FAN_OUT = 2
OVERLAP = 4
PEAKS = 3
UNIT = 64

FEATURE_FIELDS = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("fingerprint", T.ArrayType(T.LongType())),
]


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def peaks(samples: np.ndarray, frame: int = FRAME, hop: int | None = None, most: int = 1) -> np.ndarray:
    """The ``most`` strongest peaks of each frame, strongest first, -1 for silence; the last frame is filled up with the middle value."""
    hop = hop or frame
    n = max(-(-(len(samples) - frame) // hop), 0) + 1 if len(samples) else 0
    full = np.full(max(n - 1, 0) * hop + frame, 128, np.uint8)
    full[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(full, frame)[::hop][:n].astype(np.float32) - 128
    frames -= frames.mean(1, keepdims=True)
    power = np.abs(np.fft.rfft(frames * np.hanning(frame).astype(np.float32), FRAME, axis=1))[:, 1:]
    # Rounding keeps the choice among near-equal bins independent of the transform's last digits.
    power = np.round(power, 2)
    if most > 1:  # only local peaks count; the strongest bin is one
        sides = np.pad(power, ((0, 0), (1, 1)), constant_values=-1)
        power = np.where((power >= sides[:, :-2]) & (power > sides[:, 2:]), power, 0)
    found = np.full((n, most), -1, np.int64)
    for j in range(most):
        best = power.argmax(1)
        found[:, j] = np.where(power[np.arange(n), best] > 0, best + 1, -1)
        power[np.arange(n), best] = 0
    return found[:, 0] if most == 1 else found


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """Codes time << 24 | frequency << 12 | later frequency << 3 | distance of peak pairs, in order."""
    codes = []
    each = frames.reshape(len(frames), -1).T if len(frames) else []
    for d in range(1, FAN_OUT + 1):
        for a in (x[:-d] for x in each):
            for b in (x[d:] for x in each):
                t = np.flatnonzero((a >= 0) & (b >= 0))
                codes.append((t << 24) | (a[t] << 12) | (b[t] << 3) | d)
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def describe(media: bytes) -> tuple:
    """All values of FEATURE_FIELDS, from the stored bytes alone."""
    digest, tail, size, found = hashlib.sha256(), b"", 0, []
    edge = b""  # samples that the next block's first frame shares
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("mono WAV of 8-bit samples is needed")
        frame = min(FRAME, max(w.getnframes() // OVERLAP // OVERLAP * OVERLAP, UNIT // OVERLAP))
        hop = frame // OVERLAP
        edge = bytes([128]) * (frame - hop)
        while block := w.readframes(FRAME * BLOCK_FRAMES):
            digest.update(block)
            tail = (tail + block)[-UNIT:]
            size += len(block)
            samples = edge + block
            whole = (len(samples) - frame) // hop + 1 if len(samples) >= frame else 0
            if whole:
                found.append(peaks(np.frombuffer(samples, np.uint8, (whole - 1) * hop + frame), frame, hop, PEAKS))
            edge = samples[whole * hop :]
        if size:
            found.append(peaks(np.frombuffer(edge + bytes([128]) * (frame - hop), np.uint8), frame, hop, PEAKS))
    codes = fingerprint(np.concatenate(found) if found else np.zeros((0, PEAKS), np.int64))
    return size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), codes


def store_wav(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the UTF-8 bytes of ``text`` as WAV in the binary column ``media``."""
    plain = docs.drop(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            stored = [to_wav(padded((t or "").encode())) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, pa.binary())], [*batch.schema.names, media])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(media, T.BinaryType())]))


def wav_features(table: DataFrame, media: str = "media") -> DataFrame:
    """``table`` with FEATURE_FIELDS in place of the column ``media``."""
    names = [f.name for f in FEATURE_FIELDS]
    plain = table.drop(*names)
    rest = [f for f in plain.schema.fields if f.name != media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, media):
            found = [describe(m.as_py()) for m in batch.column(media)]
            new = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *new], [*(f.name for f in rest), *names])

    return plain.mapInArrow(run, T.StructType([*rest, *FEATURE_FIELDS]))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = store_wav(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).drop("text")
    features = wav_features(stored)
    return features.withColumn("feature", F.concat_ws(",", F.transform("fingerprint", lambda c: F.lower(F.hex(c))))).drop("fingerprint")
