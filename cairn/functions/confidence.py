"""Confidence algebra: independent evidence, paths and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str) -> Column:
    """Into 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(c)))


def noisy_or(c: Column | str) -> Column:
    """Aggregate: 1 minus the product of the complements; 0 over no rows."""
    return F.coalesce(1 - F.product(1 - clamp(c)), F.lit(0.0))


def noisy_or_array(c: Column | str) -> Column:
    return 1 - F.aggregate(_col(c), F.lit(1.0), lambda a, x: a * (1 - clamp(x)))


def path_product(c: Column | str) -> Column:
    """Aggregate: product along a path; 1 over no rows."""
    return F.coalesce(F.product(_col(c)), F.lit(1.0))


def path_product_array(c: Column | str) -> Column:
    return F.aggregate(_col(c), F.lit(1.0), lambda a, x: a * x)


def impact_score(confidence: Column | str, criticality: Column | str) -> Column:
    return clamp(confidence) * clamp(criticality)


def trace_confidence(count: Column | str) -> Column:
    """Ten observations make certain."""
    return F.least(_col(count) / 10, F.lit(1.0))


def depth_confidence(depth: Column | str) -> Column:
    return F.pow(F.lit(0.9), _col(depth))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Of two arrays; 0 for empty arrays, unequal lengths and zero vectors."""
    x, y = _col(a), _col(b)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double")))
    size = norm(x) * norm(y)
    return F.when((F.size(x) == 0) | (F.size(x) != F.size(y)) | (size == 0), F.lit(0.0)).otherwise(dot / size)
