"""Questions asked in one of three ways, and their hits as lines to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import bm25, dense
from quillon.plans.retrieval import Corpus, hybrid_search, with_vectors
from quillon.scale import join_in_place

MODES = ("hybrid", "dense", "bm25")
PATH_CHARS = 110
EXCERPT_CHARS = 260


def ask(corpus: Corpus, queries: DataFrame, *, mode: str = "hybrid", k: int = 5) -> DataFrame:
    """``hits(query_id, chunk_id, rank, scores..., filter_relaxed)`` of the ``k`` best in a mode.

    ``queries(query_id, text, q_*)``: filters hold in every mode; only ``hybrid`` relaxes them.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    if mode == "bm25":
        hits, rank = bm25.search(corpus.index, queries, k), "bm25_rank"
    else:
        asked = queries if "vec" in queries.columns else with_vectors(queries)
        if mode == "dense":
            hits, rank = dense.search(corpus.vectors, asked, k), "dense_rank"
        else:
            hits, rank = hybrid_search(corpus, asked), "rrf_rank"
    wanted = {
        "dense_score": "double", "dense_rank": "int", "bm25_score": "double", "bm25_rank": "int",
        "rrf_score": "double", "filter_relaxed": "boolean",
    }
    for name, kind in wanted.items():
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    return hits.where(F.col(rank) <= k).select(
        "query_id", "chunk_id", F.col(rank).alias("rank"), *wanted
    )


def _score(name: str, score: str, digits: int, rank: str | None = None) -> Column:
    shown = F.format_string(f"{name}=%.{digits}f", F.round(score, digits))
    if rank is not None:
        shown = F.concat(shown, F.lit("(#"), F.col(rank).cast("string"), F.lit(")"))
    return F.when(F.col(score).isNotNull(), shown)


def lines(hits: DataFrame, chunks: DataFrame, *, chars: int = EXCERPT_CHARS) -> DataFrame:
    """``(query_id, rank, line)``: scores, place and labels, then the path, then an excerpt."""
    scores = F.concat_ws(
        " ",
        _score("dense", "dense_score", 3, "dense_rank"),
        _score("bm25", "bm25_score", 2, "bm25_rank"),
        _score("rrf", "rrf_score", 4),
    )
    path = F.array_join("heading_path", " > ")
    tail = F.substr(path, F.greatest(F.length(path) - PATH_CHARS + 1, F.lit(1)))
    topic = F.coalesce(F.get("topics", F.lit(0)), F.lit("none"))
    place = F.concat(F.col("document_id"), F.lit(" p"), F.col("page_number").cast("string"))
    labels = F.concat(F.lit("["), F.concat_ws("/", "chunk_type", "population", topic), F.lit("]"))
    excerpt = F.translate(F.substring("text", 1, chars), "\n", " ")
    note = F.when(F.col("filter_relaxed"), F.lit("\n   (filter relaxed)")).otherwise("")
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.concat_ws("  ", scores, place, labels), note,
        F.lit("\n   "), tail, F.lit("\n   "), excerpt,
    )
    return join_in_place(chunks, hits, "chunk_id").select("query_id", "rank", line.alias("line"))
