"""Second-stage ordering by a pairwise scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A scorer maps (query text, passage text) to a number: a Column expression or a pandas UDF.
Scorer = Callable[[Column, Column], Column]


def word_overlap(query: Column, passage: Column) -> Column:
    """How many of the query's words of three letters or more are found in the passage."""
    lowered = F.lower(passage)
    words = F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: F.length(w) > 2)
    return F.size(F.filter(F.array_distinct(words), lambda w: F.contains(lowered, w))).cast("double")


def rerank(
    hits: DataFrame, incoming: str, k: int | None = 5, scorer: Scorer = word_overlap
) -> DataFrame:
    """Order ``hits(query_id, query_text, passage, <incoming rank>...)`` by the scorer.

    Equal scores keep the incoming order; earlier scores and ranks stay on the row.
    """
    scored = hits.withColumn("reranker_score", scorer(F.col("query_text"), F.col("passage")))
    order = Window.partitionBy("query_id").orderBy(
        F.round("reranker_score", 9).desc(), F.col(incoming)
    )
    ranked = scored.withColumn("reranker_rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("reranker_rank") <= k)
