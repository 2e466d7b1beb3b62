"""Hybrid retrieval and guideline search for a table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.ids import embedding_text, passage_text
from quillon.operators import bm25, dense, filters
from quillon.operators.dense import hashed_words
from quillon.operators.fusion import fuse
from quillon.operators.rerank import Scorer, rerank, word_overlap
from quillon.scale import join_in_place, spread
from quillon.session import written

MIN_RESULTS = 5
EXCERPT_CHARS = 280


@dataclass(frozen=True)
class Corpus:
    """A searchable corpus: chunk rows, their postings and their vectors."""

    chunks: DataFrame
    index: bm25.Bm25Index
    vectors: DataFrame


def prepare(
    chunks: DataFrame, *, embedder=hashed_words, stem: bm25.Stemmer = bm25.suffix_stem
) -> Corpus:
    """Index ``chunks`` for both legs. ``embedder`` maps a text column to a vector column."""
    kept = [c for c in filters.FILTER_COLUMNS if c in chunks.columns]
    text = embedding_text(F.col("document_title"), F.col("heading_path"), F.col("text"))
    vectors = written(
        spread(chunks.where("retrievable")).select("chunk_id", embedder(text).alias("vec"), *kept),
        "vectors",
    )
    return Corpus(chunks, bm25.build_index(chunks, stem=stem), vectors)


def with_vectors(queries: DataFrame, embedder=hashed_words, prefix: str = "") -> DataFrame:
    """Only the question side gets the embedder's instruction prefix."""
    return queries.withColumn("vec", embedder(F.concat(F.lit(prefix), F.col("text"))))


def _both_legs(
    corpus: Corpus, queries: DataFrame, k_dense: int, k_sparse: int, keep: int, rrf_k: int,
    sparse_text: str,
) -> DataFrame:
    return fuse(
        dense.search(corpus.vectors, queries, k_dense),
        bm25.search(corpus.index, queries, k_sparse, text=sparse_text),
        rrf_k,
        keep,
    )


def hybrid_search(
    corpus: Corpus,
    queries: DataFrame,
    *,
    k_dense: int = 15,
    k_sparse: int = 15,
    keep: int = 20,
    rrf_k: int = 60,
    min_results: int = MIN_RESULTS,
    relax: bool = True,
    sparse_text: str = "text",
) -> DataFrame:
    """Two filtered legs, fused. A question that finds too little is asked once more with
    only its population filter, and its hits say so in ``filter_relaxed``.

    ``queries(query_id, text, vec, q_*)``; ``sparse_text`` may name another text column for the
    keyword leg.
    """
    queries = written(queries, "queries")
    first = written(
        _both_legs(corpus, queries, k_dense, k_sparse, keep, rrf_k, sparse_text), "hits"
    ).withColumn("filter_relaxed", F.lit(False))
    if not relax:
        return first
    found = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"))
    again = (
        queries.join(found, "query_id", "left")
        .where(F.coalesce("_found", F.lit(0)) < min_results)
        .where(filters.relaxing_helps(queries.columns))
        .drop("_found")
    )
    again = written(filters.relax(again), "again")
    if again.isEmpty():
        return first
    second = _both_legs(corpus, again, k_dense, k_sparse, keep, rrf_k, sparse_text)
    kept = first.join(again.select("query_id"), "query_id", "left_anti")
    return kept.unionByName(second.withColumn("filter_relaxed", F.lit(True)))


def attach_passages(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts a scorer needs, for hits only: a few rows for each question."""
    passages = chunks.select(
        "chunk_id", passage_text(F.col("heading_path"), F.col("text")).alias("passage")
    )
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    return join_in_place(passages, hits.join(asked, "query_id"), "chunk_id")


def guideline_search(
    corpus: Corpus,
    queries: DataFrame,
    *,
    scorer: Scorer | None = word_overlap,
    top: int = 5,
    embedder=hashed_words,
) -> DataFrame:
    """Population of the caller, hybrid search under it, rerank, best ``top``.

    ``queries(query_id, text, age, pregnancy)``. The population is never relaxed.
    """
    asked = queries.withColumn(
        "q_population", filters.population_for(F.col("age"), F.col("pregnancy"))
    )
    asked = written(with_vectors(asked, embedder), "asked")
    hits = hybrid_search(corpus, asked)
    texts = attach_passages(hits, asked, corpus.chunks)
    if scorer is None:
        return texts.withColumn("reranker_score", F.lit(None).cast("double")).withColumn(
            "reranker_rank", F.col("rrf_rank")
        ).where(F.col("rrf_rank") <= top)
    return rerank(texts, "rrf_rank", top, scorer)


def evidence_columns() -> list[Column]:
    """What is kept of a passage as evidence: where it is from, an excerpt, its score."""
    section = F.array_join("heading_path", " > ")
    return [
        F.col("document_id"),
        F.col("document_title"),
        F.when(section != "", section).otherwise(F.lit("")).alias("section"),
        F.col("page_number"),
        F.substring("text", 1, EXCERPT_CHARS).alias("excerpt"),
        F.coalesce("reranker_score", "rrf_score", F.lit(0.0)).alias("relevance_score"),
    ]
