"""Vectors as array columns: validity, similarity, deterministic embeddings, weighted means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

MOCK_DIMENSIONS = 64


def is_sound(v: Column) -> Column:
    """Not null, not empty, every component finite."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null if either has no length or their dimensions differ."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def mock_embedding(text: Column, dimensions: int = MOCK_DIMENSIONS, unit: bool = True) -> Column:
    """Bytes of the text's SHA-256, in turn, scaled to -1..1; of length one if ``unit``."""
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    raw = let(F.sha2(text, 256), lambda d: F.transform(places, lambda i: F.conv(F.substring(d, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0))
    if not unit:
        return raw
    scaled = lambda v, size: F.transform(v, lambda x: x / F.when(size > 0, size).otherwise(1.0))
    return let(raw, lambda v: let(F.sqrt(dot(v, v)), lambda size: scaled(v, size)))


def weighted_mean(vectors: Column, weights: Column) -> Column:
    """Component-wise mean of an array of vectors by their weights; a single vector stays as it is."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w.cast("double"))
    scaled = F.zip_with(vectors, weights, lambda v, w: F.transform(v, lambda x: x.cast("double") * w.cast("double")))
    zero = F.transform(F.get(vectors, 0), lambda x: F.lit(0.0))
    mean = F.transform(F.aggregate(scaled, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), lambda x: x / total)
    return F.when(F.size(vectors) == 1, F.get(vectors, 0)).otherwise(mean)
