"""Column functions over float arrays, and codecs of stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, on_mismatch: str = "error") -> Column:
    """Cosine of two vectors, 0 if one is all zeros. Unequal lengths: ``error``, or ``zero``."""
    size = norm(a) * norm(b)
    value = F.when(size > 0, dot(a, b) / size).otherwise(0.0)
    other = F.raise_error("vectors differ in dimension").cast("double") if on_mismatch == "error" else F.lit(0.0)
    return F.when(F.size(a) == F.size(b), value).otherwise(other)


def clamped_cosine(a: Column, b: Column) -> Column:
    """Cosine with norms of 1e-12 at least."""
    least = F.lit(1e-12)
    return dot(a, b) / (F.greatest(norm(a), least) * F.greatest(norm(b), least))


def squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def normalised(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def is_finite(a: Column) -> Column:
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    return ~F.exists(a, bad)


def to_json_text(a: Column) -> Column:
    return F.to_json(a)


def from_json_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The floats of a blob; a length that isn't a multiple of four is an error."""
    for blobs in batches:
        if any(b is not None and len(b) % 4 for b in blobs):
            raise ValueError("a vector blob's length isn't a multiple of four")
        yield blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))
