"""Nearest neighbours of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.confidence import cosine_similarity


def k_nearest(embeddings: DataFrame, query: object, k: int, key: str = "address", vector: str = "vector") -> DataFrame:
    """(key, similarity), the k most alike, the query itself left out; nothing for an unknown query.

    Brute force in one scan with one broadcast row and a bounded top-k.
    """
    asked = embeddings.where(F.col(key) == query).limit(1).select(F.col(vector).alias("__q"))
    scored = embeddings.where(F.col(key) != query).crossJoin(F.broadcast(asked)).select(key, cosine_similarity(F.col(vector), F.col("__q")).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), key).limit(k)
