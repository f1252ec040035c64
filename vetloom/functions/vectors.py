"""Vectors: reading, validity and cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_vector(text: Column) -> Column:
    """A vector from JSON text; null if it is no list of numbers."""
    return usable_vector(F.from_json(text, "array<double>", {"mode": "PERMISSIVE"}))


def usable_vector(v: Column) -> Column:
    """The vector, or null if it is null, empty or holds anything that is not finite."""
    big = F.lit(float("inf"))
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.when(ok, v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either is unusable, zero or of another width."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    u, v = usable_vector(a), usable_vector(b)
    norms = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.coalesce(F.when((F.size(u) == F.size(v)) & (norms > 0), dot(u, v) / norms), F.lit(0.0))


def rounded_vector(v: Column, digits: int = 5) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))


def unit_rows(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows of this width in a batch, and their row numbers."""
    off = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = np.flatnonzero((np.diff(off) == width) & lists.is_valid().to_numpy(zero_copy_only=False))
    x = flat[off[rows][:, None] + np.arange(width)]
    norm = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(x).all(axis=1) & (norm > 0) & np.isfinite(norm)
    return x[ok] / norm[ok][:, None], rows[ok]
