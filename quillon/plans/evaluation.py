"""Evaluating retrieval systems on a question set, and the report tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import bm25, dense, filters, metrics
from quillon.operators.rerank import Scorer, rerank, word_overlap
from quillon.plans.retrieval import Corpus, attach_passages, hybrid_search
from quillon.session import written

DEPTH = 20
HITS = [
    "query_id", "chunk_id", "rank", "dense_score", "bm25_score", "rrf_score", "reranker_score",
]

# A system turns questions into ranked hits.
System = Callable[[DataFrame], DataFrame]


def _hits(df: DataFrame, rank: str) -> DataFrame:
    out = df.withColumn("rank", F.col(rank))
    for name in HITS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out.select(*HITS)


def standard_systems(corpus: Corpus, scorer: Scorer = word_overlap) -> dict[str, System]:
    """Vector, BM25, hybrid, and the reranked forms with and without the caller's filters."""

    def vector(q: DataFrame) -> DataFrame:
        return dense.search(corpus.vectors, _bare(q), DEPTH)

    def reranked(hits: DataFrame, q: DataFrame, incoming: str) -> DataFrame:
        texts = attach_passages(hits, q, corpus.chunks)
        return _hits(rerank(texts, incoming, None, scorer), "reranker_rank")

    def _bare(q: DataFrame) -> DataFrame:
        return q.drop(*[c for c in q.columns if c.startswith("q_")])

    def population_only(q: DataFrame) -> DataFrame:
        return filters.relax(q).where("age is not null")

    legs: dict[tuple[str, DataFrame], DataFrame] = {}

    def once(leg: str, q: DataFrame, run: System) -> DataFrame:
        """A leg that several systems ask the same questions is run once and stored."""
        if (leg, q) not in legs:
            legs[leg, q] = written(run(q), leg)
        return legs[leg, q]

    def nearest(q: DataFrame) -> DataFrame:
        return once("vector", q, vector)

    def hybrid(q: DataFrame) -> DataFrame:
        return once("hybrid", q, lambda q: hybrid_search(corpus, _bare(q)))

    return {
        "vector": lambda q: _hits(nearest(q), "dense_rank"),
        "bm25": lambda q: _hits(bm25.search(corpus.index, _bare(q), DEPTH), "bm25_rank"),
        "hybrid": lambda q: _hits(hybrid(q), "rrf_rank"),
        "vector+rerank": lambda q: reranked(nearest(q), q, "dense_rank"),
        "hybrid+rerank": lambda q: reranked(hybrid(q), q, "rrf_rank"),
        "hybrid+rerank+pop": lambda q: reranked(
            hybrid_search(corpus, population_only(q)), q, "rrf_rank"
        ),
        "hybrid+rerank+pop+topic": lambda q: reranked(
            hybrid_search(corpus, q.where("age is not null")), q, "rrf_rank"
        ),
    }


class StageClock:
    """Times the legs of systems: each is run to a stored table, and a row says how long it took.

    A leg answers a whole table of questions at once, so a question's share is the leg's time
    over their number.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int, float]] = []

    def stage(self, system: str, name: str, questions: int, result: DataFrame) -> DataFrame:
        start = time.perf_counter()
        stored = written(result, f"{system}-{name}".replace("+", "-"))
        self.rows.append((system, name, questions, (time.perf_counter() - start) * 1000))
        return stored

    def table(self, spark: SparkSession) -> DataFrame:
        """(system, stage, questions, total_ms, ms): a row for each leg of each system."""
        rows = [(*row, row[3] / max(1, row[2])) for row in self.rows]
        return spark.createDataFrame(
            rows, "system string, stage string, questions bigint, total_ms double, ms double"
        )


def timed_systems(
    corpus: Corpus, questions: DataFrame, scorer: Scorer = word_overlap
) -> tuple[DataFrame, DataFrame]:
    """Hits of the standard systems as ``run_systems`` gives them, and the time of each leg.

    Legs that systems share are run once for each system, as each would by itself.
    """
    spark, clock = questions.sparkSession, StageClock()
    bare = questions.drop(*[c for c in questions.columns if c.startswith("q_")])
    aged = questions.where("age is not null")
    asked = {"": bare, "+pop": filters.relax(aged), "+pop+topic": aged}
    sizes = {suffix: q.count() for suffix, q in asked.items()}
    parts = []

    def leg(system: str, kind: str, suffix: str) -> tuple[DataFrame, str]:
        q = asked[suffix]
        if kind == "vector":
            found, rank = dense.search(corpus.vectors, q, DEPTH), "dense_rank"
        elif kind == "bm25":
            found, rank = bm25.search(corpus.index, q, DEPTH), "bm25_rank"
        else:
            found, rank = hybrid_search(corpus, q), "rrf_rank"
        return clock.stage(system, kind, sizes[suffix], found), rank

    for kind in ("vector", "bm25", "hybrid"):
        parts.append((kind, _hits(*leg(kind, kind, ""))))
    for kind, suffix in (("vector", ""), ("hybrid", ""), ("hybrid", "+pop"), ("hybrid", "+pop+topic")):
        system = f"{kind}+rerank{suffix}"
        found, rank = leg(system, kind, suffix)
        texts = attach_passages(found, asked[suffix], corpus.chunks)
        ordered = clock.stage(system, "rerank", sizes[suffix], rerank(texts, rank, None, scorer))
        parts.append((system, _hits(ordered, "reranker_rank")))
    hits = reduce(
        DataFrame.unionByName, [rows.withColumn("system", F.lit(name)) for name, rows in parts]
    )
    return hits, clock.table(spark)


def run_systems(systems: dict[str, System], questions: DataFrame) -> DataFrame:
    """``hits(system, query_id, chunk_id, rank, scores...)`` of every system.

    Filtered systems are only asked the questions whose caller's age is known.
    """
    parts = [
        run(questions).withColumn("system", F.lit(name)) for name, run in systems.items()
    ]
    return written(reduce(DataFrame.unionByName, parts), "runs")


def asked_by(systems: dict[str, System], questions: DataFrame) -> DataFrame:
    """(system, question...) for every question a system was asked."""
    names = F.array(*[F.lit(n) for n in systems])
    filtered = F.col("system").endswith("+pop") | F.col("system").endswith("+topic")
    return questions.withColumn("system", F.explode(names)).where(
        ~filtered | F.col("age").isNotNull()
    )


def score_runs(
    hits: DataFrame, asked: DataFrame, relevant: DataFrame
) -> DataFrame:
    """One row per (system, question): its metrics, first relevant rank and top score.

    ``relevant(query_id, chunk_id, units_hit)`` lists the relevant chunks of the corpus with
    the gold units each one satisfies.
    """
    totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    rel = hits.join(relevant, ["query_id", "chunk_id"]).select(
        "system", "query_id", "rank", "units_hit"
    )
    scored = metrics.question_scores(asked, rel, totals)
    tops = hits.where("rank = 1").select(
        "system", "query_id", metrics.top_score().alias("top_score")
    )
    return scored.join(tops, ["system", "query_id"], "left")
