"""Embedding: the deterministic hashed n-gram provider, a provider interface and registry, and checks of vectors."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.vectors import is_finite

DOCUMENT, QUERY = "DOCUMENT", "QUERY"
DIMENSION = 64
BATCH = 32
KEPT_GRAMS = 1_000_000
SLICE_CHARS = 500_000


@dataclass(frozen=True)
class ModelInfo:
    """What makes two vectors comparable."""

    model_id: str
    model_name: str
    model_version: str
    dimension: int
    config_hash: str
    runtime: str
    precision: str = "float32"
    normalize: bool = True
    pooling: str = "mean"
    max_length: int | None = None
    query_prefix: str | None = None
    document_prefix: str | None = None


class EmbeddingProvider(Protocol):
    """Adds ``output`` (array of floats) for the texts of a column."""

    info: ModelInfo

    def transform(self, df: DataFrame, text: str = "text", output: str = "vector", input_type: str = DOCUMENT) -> DataFrame: ...


_grams: dict[tuple[int, int], tuple[int, int]] = {}


def _hashed(value: int, n: int) -> tuple[int, int]:
    """The first eight bytes of a gram's SHA-256 as a little-endian number, and the sign from the ninth. ``value`` holds
    its n characters, of 21 bits each."""
    found = _grams.get((value, n))
    if found is None:
        digest = hashlib.sha256("".join(chr(value >> 21 * (n - 1 - j) & 0x1FFFFF) for j in range(n)).encode()).digest()
        found = int.from_bytes(digest[:8], "little"), 1 if digest[8] % 2 == 0 else -1
        if len(_grams) >= KEPT_GRAMS:
            _grams.clear()
        _grams[value, n] = found
    return found


def hashed_ngrams(texts: list[str | None], dimension: int = DIMENSION) -> np.ndarray:
    """A row per text: signed counts of its 1- to 3-grams of lower-cased characters, of length 1 unless all are 0.

    The n-grams of SLICE_CHARS characters are made distinct at once, so each of these is hashed once.
    """
    out = np.zeros((len(texts), dimension))
    lowered = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) for t in lowered])
    start = 0
    while start < len(texts) and dimension:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_CHARS, side="right")))
        part = lowered[start:stop]
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.uint64)
        rows = np.repeat(np.arange(len(part)), [len(t) for t in part])
        for n in (1, 2, 3):
            m = len(codes) - n + 1
            if m <= 0:
                break
            packed = codes[:m].copy()
            for j in range(1, n):
                packed = (packed << np.uint64(21)) | codes[j : m + j]
            at = np.flatnonzero(rows[:m] == rows[n - 1 :])
            coded = pa.array(packed[at]).dictionary_encode()
            which = coded.indices.to_numpy()
            hashed = [_hashed(value, n) for value in coded.dictionary.to_pylist()]
            spots = np.array([spot % dimension for spot, _ in hashed], np.int64)[which] if hashed else which
            signs = np.array([sign for _, sign in hashed], np.float64)[which] if hashed else which
            out[start:stop] += np.bincount(rows[at] * dimension + spots, signs, len(part) * dimension).reshape(len(part), dimension)
        start = stop
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


class HashedNgramProvider:
    """Works without a model; for tests and as a lexical baseline. Vectors of dimension 0 are empty."""

    def __init__(self, dimension: int = DIMENSION):
        self.info = ModelInfo(
            "deterministic-mock-v1", "Deterministic hashed character n-grams", "1", dimension, f"mock-char-ngram-d{dimension}-v1", "rust-mock", pooling="hashed-char-ngram"
        )

    def transform(self, df: DataFrame, text: str = "text", output: str = "vector", input_type: str = DOCUMENT) -> DataFrame:
        plain, dimension = df.drop(output), self.info.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = hashed_ngrams(batch.column(text).to_pylist(), dimension).astype(np.float32)
                offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * dimension
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, output])

        return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))]))


# The neural models that a provider may run, whose runtimes aren't part of this library, with name,
# version, dimension and configuration hash.
NEURAL = {
    "bge-small": ("BAAI/bge-small-zh-v1.5", "v1.5", 512, "st-bge-small-zh-v1.5-f32-normalized-model-pooling-v1"),
    "m3e-base": ("moka-ai/m3e-base", "configured", 768, "st-m3e-base-f32-normalized-model-pooling-v1"),
    "bge-m3": ("BAAI/bge-m3", "configured", 1024, "st-bge-m3-f32-normalized-model-pooling-v1"),
}
NEURAL_MODELS = {model_id: dimension for model_id, (_, _, dimension, _) in NEURAL.items()}


def neural_model(model_id: str) -> ModelInfo:
    """The identity of a neural model's vectors; KeyError for an unknown one."""
    name, version, dimension, config_hash = NEURAL[model_id]
    return ModelInfo(
        model_id=model_id, model_name=name, model_version=version, dimension=dimension, config_hash=config_hash, runtime="python-sentence-transformers",
        precision="f32", normalize=True, pooling="model-defined", max_length=None, query_prefix=None, document_prefix=None,
    )


class ProviderRegistry:
    """Providers by model id; registering an id again replaces it."""

    def __init__(self):
        self._providers: dict[str, EmbeddingProvider] = {}

    def register(self, provider: EmbeddingProvider) -> None:
        self._providers[provider.info.model_id] = provider

    def get(self, model_id: str) -> EmbeddingProvider:
        if model_id not in self._providers:
            raise KeyError(f"no embedding provider {model_id}")
        return self._providers[model_id]

    def ids(self) -> list[str]:
        return sorted(self._providers)

    def infos(self) -> list[ModelInfo]:
        return [self._providers[i].info for i in self.ids()]


#: What a request to an embedding service may hold at most.
MAX_BATCH, MAX_BYTES = 128, 10 << 20


class HttpProvider:
    """Batches of texts to an embedding service: POST ``{model_id, inputs}``, answer ``{model_info, outputs}``.

    A request has ``batch`` texts (MAX_BATCH at most) and ``max_bytes`` at most. A service that fails or can't be reached
    is asked again after a pause that doubles, ``retries`` times. A request that it refuses, or whose answer doesn't fit
    (other model, number, order or dimension, values that aren't finite), is halved until the texts at fault stand alone.
    With ``errors``, the name of a column, these rows get no vector and what went wrong there; without, they raise.
    ``normalize=False`` asks for vectors as the model gives them; ``tokens`` names a column for the answer's token counts.
    """

    def __init__(self, url: str, info: ModelInfo, batch: int = BATCH, timeout: float = 60.0, max_bytes: int = MAX_BYTES, retries: int = 3, pause: float = 0.5, errors: str | None = None, tokens: str | None = None, normalize: bool = True):
        self.url, self.info, self.batch, self.timeout = url, info, min(max(1, batch), MAX_BATCH), timeout
        self.max_bytes, self.retries, self.pause, self.errors, self.tokens, self.normalize = max_bytes, retries, pause, errors, tokens, normalize

    def _body(self, texts: list[str], input_type: str) -> bytes:
        inputs = [{"request_id": str(i), "input_type": input_type, "text": t} for i, t in enumerate(texts)]
        return json.dumps({"model_id": self.info.model_id, "inputs": inputs} | ({} if self.normalize else {"normalize": False}), ensure_ascii=False).encode()

    def _ask(self, texts: list[str], input_type: str) -> list[tuple[list[float] | None, int | None, str | None]]:
        """Vector, token count and error of each text."""
        request = urllib.request.Request(self.url, self._body(texts, input_type), {"Content-Type": "application/json"})
        for n in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as got:
                    answer = json.load(got)
                vectors = checked_response(answer, self.info, [str(i) for i in range(len(texts))])
                return [(v, o.get("token_count"), None) for v, o in zip(vectors, answer["outputs"], strict=True)]
            except urllib.error.HTTPError as refused:
                why = f"{refused.code} {refused.reason}"
                if refused.code < 500 and refused.code != 429:
                    break  # asking again won't help
            except ValueError as wrong:
                why = str(wrong)
                break
            except OSError as failed:
                why = str(failed)
            if n < self.retries:
                time.sleep(self.pause * 2**n)
        else:
            return [(None, None, why)] * len(texts)
        if len(texts) == 1:
            return [(None, None, why)]
        half = len(texts) // 2
        return self._ask(texts[:half], input_type) + self._ask(texts[half:], input_type)

    def _parts(self, texts: list[str], input_type: str) -> Iterator[tuple[int, int]]:
        """Bounds of the requests: ``batch`` texts and ``max_bytes`` at most, or one text that is too large alone."""
        sizes = [len(self._body([t], input_type)) for t in texts]  # a little more than their share of a request
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start == self.batch or total + size > self.max_bytes):
                yield start, i
                start, total = i, 0
            total += size
        if start < len(texts):
            yield start, len(texts)

    def transform(self, df: DataFrame, text: str = "text", output: str = "vector", input_type: str = DOCUMENT) -> DataFrame:
        plain = df.drop(output, *(c for c in (self.errors, self.tokens) if c))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(text).to_pylist()]
                for a, b in self._parts(texts, input_type):
                    large = b - a == 1 and len(self._body(texts[a:b], input_type)) > self.max_bytes
                    found = [(None, None, "the text is larger than a request may be")] if large else self._ask(texts[a:b], input_type)
                    bad = next((e for *_, e in found if e), None)
                    if bad and self.errors is None:
                        raise ValueError(bad)
                    part = batch.slice(a, b - a)
                    columns = [pa.array([v for v, _, _ in found], pa.list_(pa.float32()))]
                    columns += [pa.array([e for *_, e in found], pa.string())] if self.errors else []
                    columns += [pa.array([n for _, n, _ in found], pa.int64())] if self.tokens else []
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, output, *(c for c in (self.errors, self.tokens) if c)])

        more = [T.StructField(c, k) for c, k in ((self.errors, T.StringType()), (self.tokens, T.LongType())) if c]
        return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(output, T.ArrayType(T.FloatType())), *more]))


def checked_response(answer: dict, info: ModelInfo, request_ids: list[str]) -> list[list[float]]:
    """The vectors of a service's answer, or a ValueError that says what doesn't match the request."""
    told = answer.get("model_info", {})
    if any(told.get(k) != v for k, v in asdict(info).items() if k in told) or told.get("model_id") != info.model_id:
        raise ValueError("the answer comes from another model")
    outputs = answer.get("outputs", [])
    if [o.get("request_id") for o in outputs] != request_ids:
        raise ValueError("the answer's outputs don't match the requests in number and order")
    vectors = [o.get("vector", []) for o in outputs]
    if any(len(v) != info.dimension for v in vectors):
        raise ValueError(f"a vector's dimension isn't {info.dimension}")
    if not np.isfinite(np.array(vectors, float)).all():
        raise ValueError("a vector has a value that isn't finite")
    return vectors


def vector_faults(vectors: DataFrame, dimension: int, chunks: DataFrame | None = None) -> DataFrame:
    """``vectors`` (chunk_id, vector) with ``fault``: why a row can't be stored, null if it can."""
    checks: list[tuple[Column, str]] = [
        (F.col("chunk_id").isNull(), "no chunk_id"),
        (F.coalesce(F.size("vector"), F.lit(-1)) != dimension, "dimension differs"),
        (~is_finite(F.col("vector")), "value isn't finite"),
    ]
    if "input_type" in vectors.columns:
        checks.append((F.col("input_type") != DOCUMENT, "only documents can be stored"))
    own = vectors
    if chunks is not None:
        known = chunks.select("chunk_id").distinct().withColumn("_known", F.lit(True))
        own = vectors.join(known, "chunk_id", "left")
        checks.append((F.col("_known").isNull(), "chunk isn't part of the knowledge base"))
    fault = None
    for test, why in checks:
        fault = F.when(test, why) if fault is None else fault.when(test, why)
    return own.withColumn("fault", fault).drop("_known")


def checked_batch(vectors: DataFrame, dimension: int, chunks: DataFrame | None = None) -> DataFrame:
    """``vectors`` if all rows can be stored, else a ValueError with the first fault; nothing is stored in part."""
    if dimension <= 0:
        raise ValueError("embedding dimension must be greater than zero")
    if vectors.isEmpty():
        raise ValueError("vector batch is empty")
    bad = vector_faults(vectors, dimension, chunks).where("fault IS NOT NULL").orderBy("chunk_id").select("chunk_id", "fault").first()
    if bad is not None:
        raise ValueError(f"chunk {bad.chunk_id}: {bad.fault}")
    return vectors
