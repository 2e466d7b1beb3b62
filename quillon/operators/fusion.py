"""Reciprocal rank fusion of ranked legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(
    dense: DataFrame,
    sparse: DataFrame,
    k: int = RRF_K,
    keep: int | None = 20,
    *,
    dense_weight: float = 1.0,
    sparse_weight: float = 1.0,
) -> DataFrame:
    """One list from two: score is the sum of weight / (k + rank); ties by best rank, then id.

    A union of the legs and one aggregation does the work of a full outer join with a single
    shuffle. Every hit keeps the score and rank of each leg it came from.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    legs = dense.select(
        "query_id", "chunk_id", "dense_score", "dense_rank",
        F.lit(None).cast("double").alias("bm25_score"), F.lit(None).cast("int").alias("bm25_rank"),
    ).unionByName(
        sparse.select(
            "query_id", "chunk_id", F.lit(None).cast("double").alias("dense_score"),
            F.lit(None).cast("int").alias("dense_rank"), "bm25_score", "bm25_rank",
        )
    )
    part = F.coalesce(
        F.lit(dense_weight) / (F.lit(k) + F.col("dense_rank")),
        F.lit(sparse_weight) / (F.lit(k) + F.col("bm25_rank")),
    )
    fused = legs.groupBy("query_id", "chunk_id").agg(
        F.max("dense_score").alias("dense_score"),
        F.max("dense_rank").alias("dense_rank"),
        F.max("bm25_score").alias("bm25_score"),
        F.max("bm25_rank").alias("bm25_rank"),
        F.sum(part).alias("rrf_score"),
        F.min(F.coalesce("dense_rank", "bm25_rank")).alias("_best"),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.round("rrf_score", 9).desc(), F.col("_best"), F.col("chunk_id")
    )
    ranked = fused.withColumn("rrf_rank", F.row_number().over(order)).drop("_best")
    return ranked if keep is None else ranked.where(F.col("rrf_rank") <= keep)
