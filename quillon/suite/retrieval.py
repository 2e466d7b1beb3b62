"""Retrieval over the driver's documents: chunks, questions, legs, fusion, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.ids import content_hash, embedding_text, point_id
from quillon.operators import bm25, dense, filters, metrics, stats
from quillon.operators.dense import hashed_words
from quillon.operators.fusion import fuse
from quillon.plans import evaluation, surface
from quillon.plans.retrieval import (
    Corpus, evidence_columns, guideline_search, hybrid_search, prepare, with_vectors,
)
from quillon.session import shared_dir, written
from quillon.sources import evalset
from quillon.sources.reports import write_lines
from quillon.suite.base import register, table

# --- the tables as a retrieval corpus ---------------------------------------------------------


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: the language says whom a chunk is for, the source is its document."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        F.array("source").alias("heading_path"),
        F.col("source").alias("document_id"),
        F.col("source").alias("document_title"),
        F.concat(F.lit("type"), F.col("doc_id") % 3).alias("document_type"),
        F.when(F.col("lang") == "en", "adult")
        .when(F.col("lang") == "fr", "child")
        .when(F.col("lang") == "es", "pregnancy")
        .otherwise("all")
        .alias("population"),
        F.array(F.concat(F.lit("t"), F.col("doc_id") % 7)).alias("topics"),
        F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text").alias("chunk_type"),
        F.col("doc_id").alias("page_number"),
        (F.col("n_chars") >= 40).alias("retrievable"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions, with what is known of their callers."""
    b = table(spark, sf, "benchmark")
    turn = F.col("item_id") % 4
    return b.select(
        F.col("item_id").alias("query_id"),
        "text",
        F.when(turn == 1, 30).when(turn == 2, 8).when(turn == 3, 25).alias("age"),
        F.when(turn == 3, "yes").when(turn == 1, "not pregnant").alias("pregnancy"),
        F.element_at(
            F.array(F.lit("symptom"), F.lit("medication"), F.lit("follow_up")),
            (F.col("item_id") % 3 + 1).cast("int"),
        ).alias("category"),
        F.when(F.col("item_id") % 5 == 0, F.array(F.lit("t1"), F.lit("t2")))
        .when(F.col("item_id") % 5 == 1, F.array(F.lit("t9")))
        .alias("q_topics"),
    )


def filtered(q: DataFrame) -> DataFrame:
    return q.withColumn("q_population", filters.population_for(F.col("age"), F.col("pregnancy")))


def corpus(spark: SparkSession, sf: str) -> Corpus:
    return prepare(chunks(spark, sf))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant = holds the question's passage word for word."""
    usable = chunks(spark, sf).where("retrievable").select("chunk_id", "text")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return metrics.containing_chunks(usable, asked)


# --- the same in SQL --------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in bm25.STOP_WORDS)
TOKEN = bm25.TOKEN


def stem_sql(w: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace({w}, '(ss|i)es$', '\\1'), "
        "'([^s])s$', '\\1'), '^(.*[aeiouy].*)(ing|ed)$', '\\1')"
    )


CHUNKS = """
chunks AS (SELECT doc_id AS chunk_id, text, source AS document_id, 'type' || (doc_id % 3) AS document_type,
  CASE lang WHEN 'en' THEN 'adult' WHEN 'fr' THEN 'child' WHEN 'es' THEN 'pregnancy' ELSE 'all' END AS population,
  't' || (doc_id % 7) AS topic, CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'text' END AS chunk_type
  FROM documents WHERE n_chars >= 40)"""
QUESTIONS = """
questions AS (SELECT item_id AS query_id, text,
  CASE item_id % 4 WHEN 1 THEN 30 WHEN 2 THEN 8 WHEN 3 THEN 25 END AS age,
  CASE item_id % 3 WHEN 0 THEN 'symptom' WHEN 1 THEN 'medication' ELSE 'follow_up' END AS category,
  CASE item_id % 4 WHEN 1 THEN ['adult', 'all'] WHEN 2 THEN ['child', 'all']
    WHEN 3 THEN ['adult', 'all', 'pregnancy'] END AS q_population,
  CASE item_id % 5 WHEN 0 THEN ['t1', 't2'] WHEN 1 THEN ['t9'] END AS q_topics FROM benchmark)"""


def terms_sql(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS w FROM {source}),
{name} AS (SELECT {key}, {stem_sql('w')} AS term, count(*) AS tf FROM {name}_w
  WHERE w NOT IN ({STOP}) GROUP BY 1, 2)"""


POSTINGS = (
    terms_sql("tf", "chunks", "chunk_id", "document_id || chr(10) || text")
    + """,
len AS (SELECT chunk_id, sum(tf) AS length FROM tf GROUP BY 1),
total AS (SELECT count(*) AS n, (SELECT sum(tf) FROM tf) / count(*) AS mean_length FROM chunks),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
post AS (SELECT chunk_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf
  / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean_length)) AS w
  FROM tf JOIN df USING (term) JOIN len USING (chunk_id), total)"""
)
PASSES = """(q_population IS NULL OR list_contains(q_population, population))
  AND (q_topics IS NULL OR list_contains(q_topics, topic))"""


def bm25_sql(name: str, asked: str, k: int, where: str = "true") -> str:
    return (
        terms_sql(f"{name}_t", asked, "query_id", "text")
        + f""",
{name}_s AS (SELECT query_id, chunk_id, sum(w * q.tf) AS bm25_score FROM {name}_t q JOIN post USING (term)
  GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id
    ORDER BY round(bm25_score, 9) DESC, chunk_id) AS bm25_rank
  FROM {name}_s s JOIN chunks USING (chunk_id) JOIN {asked} a USING (query_id)
  WHERE bm25_score > 0 AND {where}) WHERE bm25_rank <= {k})"""
    )


def vectors_sql(name: str, source: str, key: str, text: str) -> str:
    """Hashed bag-of-words vectors as (key, slot, x) rows."""
    return f"""
{name}_w AS (SELECT {key}, ('0x' || right(md5(unnest(regexp_extract_all(lower({text}), '[a-z]+'))), 8))::BIGINT % 64 AS slot
  FROM {source}),
{name}_c AS (SELECT {key}, slot, count(*)::DOUBLE AS c FROM {name}_w GROUP BY 1, 2),
{name} AS (SELECT {key}, slot, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS x FROM {name}_c)"""


VECTORS = vectors_sql("cv", "chunks", "chunk_id", "document_id || ' > ' || document_id || chr(10) || text")


def dense_sql(name: str, asked: str, k: int, where: str = "true") -> str:
    return (
        vectors_sql(f"{name}_v", asked, "query_id", "text")
        + f""",
{name}_s AS (SELECT query_id, chunk_id, round(coalesce(d, 0), 9) AS dense_score FROM
  (SELECT query_id, chunk_id FROM (SELECT DISTINCT query_id FROM {asked}), chunks) LEFT JOIN
  (SELECT query_id, chunk_id, sum(v.x * cv.x) AS d FROM {name}_v v JOIN cv USING (slot) GROUP BY 1, 2)
  USING (query_id, chunk_id)),
{name} AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id
    ORDER BY dense_score DESC, chunk_id) AS dense_rank
  FROM {name}_s s JOIN chunks USING (chunk_id) JOIN {asked} a USING (query_id) WHERE {where})
  WHERE dense_rank <= {k})"""
    )


def fuse_sql(name: str, d: str, s: str, keep: int) -> str:
    return f"""
{name}_u AS (SELECT query_id, chunk_id, max(dense_score) AS dense_score, max(dense_rank) AS dense_rank,
    max(bm25_score) AS bm25_score, max(bm25_rank) AS bm25_rank,
    sum(1.0::DOUBLE / (60 + coalesce(dense_rank, bm25_rank))) AS rrf_score,
    min(coalesce(dense_rank, bm25_rank)) AS best FROM
  (SELECT query_id, chunk_id, dense_score, dense_rank, NULL AS bm25_score, NULL AS bm25_rank FROM {d}
   UNION ALL SELECT query_id, chunk_id, NULL, NULL, bm25_score, bm25_rank FROM {s}) GROUP BY 1, 2),
{name} AS (SELECT * EXCLUDE (best) FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY round(rrf_score, 9) DESC, best, chunk_id) AS rrf_rank FROM {name}_u) WHERE rrf_rank <= {keep})"""


def hybrid_sql(name: str, asked: str, where: str = PASSES) -> str:
    return (
        dense_sql(f"{name}_d", asked, 15, where) + "," + bm25_sql(f"{name}_b", asked, 15, where)
        + "," + fuse_sql(name, f"{name}_d", f"{name}_b", 20)
    )


def relaxed_sql(name: str, asked: str) -> str:
    """Hybrid with the second pass for questions that found fewer than five chunks."""
    return (
        hybrid_sql(f"{name}_1", asked)
        + f""",
{name}_a AS (SELECT q.* REPLACE (NULL::VARCHAR[] AS q_topics) FROM {asked} q WHERE q_topics IS NOT NULL
  AND (SELECT count(*) FROM {name}_1 h WHERE h.query_id = q.query_id) < 5),"""
        + hybrid_sql(f"{name}_2", f"{name}_a")
        + f""",
{name} AS (SELECT *, false AS filter_relaxed FROM {name}_1 WHERE query_id NOT IN (SELECT query_id FROM {name}_a)
  UNION ALL SELECT *, true FROM {name}_2)"""
    )


GOLD = """
gold AS (SELECT b.item_id AS query_id, c.chunk_id FROM benchmark b JOIN chunks c ON contains(c.text, b.text)),
totals AS (SELECT query_id, count(*) AS total FROM gold GROUP BY 1)"""
BASE = f"WITH {CHUNKS},{QUESTIONS}"
RRF = "round(rrf_score, 6) AS rrf_score"


def metrics_sql(hits: str, asked: str) -> str:
    """Per-question metrics of ``hits(system, query_id, chunk_id, rank)``."""
    ks = metrics.KS
    return f"""
rel AS (SELECT h.system, h.query_id, h.rank FROM {hits} h JOIN gold USING (query_id, chunk_id)),
agg AS (SELECT system, query_id, min(rank) AS first,
    sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END) AS dcg_5,
    sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg_10 FROM rel GROUP BY 1, 2),
ideal AS (SELECT query_id, sum(CASE WHEN r <= 5 THEN 1 / log2(r + 1) END) AS i5,
    sum(1 / log2(r + 1)) AS i10 FROM (SELECT query_id, unnest(range(1, least(total, 10) + 1)) AS r FROM totals)
  GROUP BY 1),
per_q AS (SELECT a.system, a.query_id, a.category, CASE WHEN t.total IS NULL THEN 'abstain' ELSE 'answer' END AS expected,
  first, {', '.join(f"(coalesce(first <= {k}, false))::INT::DOUBLE AS hit_{k}" for k in ks)},
  {', '.join(f"CASE WHEN t.total IS NULL THEN 0.0 ELSE (coalesce(first <= {k}, false))::INT::DOUBLE END AS recall_{k}" for k in ks)},
  coalesce(1.0::DOUBLE / first, 0) AS rr, coalesce(dcg_5 / i5, 0) AS ndcg_5, coalesce(dcg_10 / i10, 0) AS ndcg_10
  FROM {asked} a LEFT JOIN agg g USING (system, query_id) LEFT JOIN totals t ON t.query_id = a.query_id
  LEFT JOIN ideal i ON i.query_id = a.query_id)"""


METRIC_NAMES = [f"hit_{k}" for k in metrics.KS] + [f"recall_{k}" for k in metrics.KS]
MEANS = ", ".join(
    f"round(avg({n}), 6) AS {'mrr' if n == 'rr' else n}"
    for n in [*METRIC_NAMES, "rr", "ndcg_5", "ndcg_10"]
)

# --- registered queries -----------------------------------------------------------------------


@register(
    "bm25_corpus_statistics", "A5 H16-style terms, S13",
    f"{BASE},{POSTINGS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, total",
)
def bm25_corpus_statistics(spark: SparkSession, sf: str) -> DataFrame:
    index = bm25.build_index(chunks(spark, sf))
    return index.df.select(
        "term", "df", F.round(bm25.idf(index.chunks, F.col("df")), 6).alias("idf")
    )


@register(
    "bm25_search", "B1 J2 T1 W1",
    f"{BASE},{POSTINGS},{bm25_sql('hits', 'questions', 15)} "
    "SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score, bm25_rank FROM hits",
)
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    index = bm25.build_index(chunks(spark, sf))
    asked = questions(spark, sf).select("query_id", "text")
    hits = bm25.search(index, asked, 15)
    return hits.withColumn("bm25_score", F.round("bm25_score", 6))


@register(
    "query_lines", "S21",
    f"""{BASE},{POSTINGS},{bm25_sql('hits', 'questions', 5, PASSES)}
    SELECT query_id, bm25_rank AS rank, bm25_rank || '. bm25=' || printf('%.2f', round(bm25_score, 2)) || '(#' || bm25_rank || ')  ' || c.document_id || ' p' || c.chunk_id
      || '  [' || CASE WHEN c.chunk_id % 5 = 0 THEN 'table' ELSE 'text' END || '/' || c.population || '/' || c.topic || ']' || chr(10) || '   ' || c.document_id
      || chr(10) || '   ' || replace(substring(c.text, 1, 260), chr(10), ' ') AS line
    FROM hits JOIN chunks c USING (chunk_id)""",
)
def query_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered questions asked by words, as lines to read."""
    c = written(chunks(spark, sf), "chunks")
    index = bm25.build_index(c)
    hits = surface.ask(Corpus(c, index, c), filtered(questions(spark, sf)), mode="bm25")
    return surface.lines(hits, c)


@register("query_lines_hybrid", "S21")
def query_lines_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The same by both legs; filters that leave too little are relaxed, and the lines say so."""
    c = corpus(spark, sf)
    return surface.lines(surface.ask(c, filtered(questions(spark, sf))), c.chunks)


@register("system_timings", "F4")
def system_timings(spark: SparkSession, sf: str) -> DataFrame:
    """How long each leg of each retrieval system takes for the benchmark questions."""
    asked = written(with_vectors(filtered(questions(spark, sf))), "asked")
    return evaluation.timed_systems(corpus(spark, sf), asked)[1]


@register(
    "bm25_filtered_search", "P1 B1 T1",
    f"{BASE},{POSTINGS},{bm25_sql('hits', 'questions', 15, PASSES)} "
    "SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score, bm25_rank FROM hits",
)
def bm25_filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    index = bm25.build_index(chunks(spark, sf))
    hits = bm25.search(index, filtered(questions(spark, sf)), 15)
    return hits.withColumn("bm25_score", F.round("bm25_score", 6))


@register(
    "dense_search", "J3 T2 W1 F2",
    """SELECT q.vec_id AS query_id, v.vec_id AS chunk_id,
      round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dense_score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY
        round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS dense_rank
    FROM embeddings q, embeddings v QUALIFY dense_rank <= 15""",
)
def dense_search(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("vec", F.col("embedding").cast("array<double>"))
    hits = dense.search(
        e.select(F.col("vec_id").alias("chunk_id"), "vec"),
        e.select(F.col("vec_id").alias("query_id"), "vec"),
        15,
    )
    return hits.withColumn("dense_score", F.round("dense_score", 6))


@register(
    "dense_filtered_search", "J3 P1 T2",
    """SELECT q.vec_id AS query_id, v.vec_id AS chunk_id,
      round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS dense_score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY
        round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS dense_rank
    FROM embeddings q, embeddings v WHERE q.label = v.label QUALIFY dense_rank <= 15""",
)
def dense_filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("string").alias("document_type"),
    )
    hits = dense.search(
        e.withColumnRenamed("vec_id", "chunk_id"),
        e.select(
            F.col("vec_id").alias("query_id"), "vec",
            F.array("document_type").alias("q_document_type"),
        ),
        15,
    )
    return hits.withColumn("dense_score", F.round("dense_score", 6))


@register(
    "rank_fusion", "J4 T3 U1",
    f"{BASE},{POSTINGS},{VECTORS},{hybrid_sql('f', 'questions', 'true')} "
    f"SELECT query_id, chunk_id, dense_rank, bm25_rank, {RRF}, rrf_rank FROM f",
)
def rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    asked = written(
        with_vectors(questions(spark, sf).select("query_id", "text")), "queries"
    )
    fused = fuse(dense.search(c.vectors, asked, 15), bm25.search(c.index, asked, 15))
    return fused.select(
        "query_id", "chunk_id", "dense_rank", "bm25_rank",
        F.round("rrf_score", 6).alias("rrf_score"), "rrf_rank",
    )


@register(
    "hybrid_search", "B2 P1 P2 P3 J4",
    f"{BASE},{POSTINGS},{VECTORS},{relaxed_sql('h', 'questions')} "
    f"SELECT query_id, chunk_id, dense_rank, bm25_rank, {RRF}, rrf_rank, filter_relaxed FROM h",
)
def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    asked = with_vectors(filtered(questions(spark, sf)))
    hits = hybrid_search(corpus(spark, sf), asked)
    return hits.select(
        "query_id", "chunk_id", "dense_rank", "bm25_rank",
        F.round("rrf_score", 6).alias("rrf_score"), "rrf_rank", "filter_relaxed",
    )


OVERLAP = """len(list_filter(list_distinct(string_split_regex(lower(q.text), '\\s+')),
    lambda w: length(w) > 2 AND contains(lower(c.document_id || chr(10) || c.text), w)))"""


def rerank_sql(name: str, hits: str, incoming: str) -> str:
    return f"""
{name} AS (SELECT h.*, {OVERLAP}::DOUBLE AS reranker_score, row_number() OVER (PARTITION BY h.query_id
    ORDER BY {OVERLAP} DESC, {incoming}) AS reranker_rank
  FROM {hits} h JOIN questions q USING (query_id) JOIN chunks c USING (chunk_id))"""


POPULATION_ONLY = "questions_p AS (SELECT * REPLACE (NULL::VARCHAR[] AS q_topics) FROM questions)"


@register(
    "guideline_search", "B3 B4 T4 P5 H11 H30 F3",
    f"{BASE},{POSTINGS},{VECTORS},{POPULATION_ONLY},{hybrid_sql('h', 'questions_p')},{rerank_sql('r', 'h', 'rrf_rank')} "
    """SELECT r.query_id, r.chunk_id, reranker_score, reranker_rank, rrf_rank, c.document_id, c.document_id AS document_title,
      c.document_id AS section, c.chunk_id AS page_number, substring(c.text, 1, 280) AS excerpt,
      reranker_score AS relevance_score FROM r JOIN chunks c USING (chunk_id) WHERE reranker_rank <= 5""",
)
def guidelines(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf)
    asked = questions(spark, sf).select("query_id", "text", "age", "pregnancy")
    hits = guideline_search(c, asked)
    return hits.join(c.chunks, "chunk_id").select(
        "query_id", "chunk_id", "reranker_score", "reranker_rank", "rrf_rank", *evidence_columns()
    )


@register(
    "gold_passages", "P9 J5",
    f"WITH {CHUNKS},{GOLD} SELECT query_id, chunk_id FROM gold",
)
def gold_passages(spark: SparkSession, sf: str) -> DataFrame:
    return gold(spark, sf)


def answerable(asked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Questions with gold are to be answered; the others are for abstaining."""
    has = relevant.select("query_id").distinct().withColumn("_has", F.lit(1))
    return (
        asked.join(has, "query_id", "left")
        .withColumn("expected", F.when(F.col("_has") == 1, "answer").otherwise("abstain"))
        .withColumn("units", F.coalesce("_has", F.lit(0)))
        .drop("_has")
    )


@register(
    "passage_retrieval_metrics", "A7 H31 W2 B1",
    f"{BASE},{POSTINGS},{bm25_sql('b', 'questions', 20)},{GOLD},"
    "runs AS (SELECT 'bm25' AS system, query_id, chunk_id, bm25_rank AS rank FROM b),"
    "asked AS (SELECT 'bm25' AS system, * FROM questions),"
    f"{metrics_sql('runs', 'asked')} "
    f"SELECT system, count(*) AS n, {MEANS} FROM per_q WHERE expected = 'answer' GROUP BY system",
)
def passage_retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """For each benchmark passage, do the first BM25 hits hold the documents it came from?"""
    index = bm25.build_index(chunks(spark, sf))
    asked = questions(spark, sf).select("query_id", "text", "category", "age")
    hits = bm25.search(index, asked, evaluation.DEPTH)
    # Read twice: its relevant hits, its top scores.
    runs = written(evaluation._hits(hits, "bm25_rank").withColumn("system", F.lit("bm25")), "runs")
    relevant = written(gold(spark, sf), "gold").withColumn("units_hit", F.array(F.lit(0)))
    rows = answerable(asked.withColumn("system", F.lit("bm25")).drop("text"), relevant)
    return metrics.system_metrics(evaluation.score_runs(runs, rows, relevant))


def evaluated(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    """Per-question scores of every system (or the named ones)."""
    c = corpus(spark, sf)
    relevant = written(gold(spark, sf), "gold").withColumn("units_hit", F.array(F.lit(0)))
    asked = answerable(with_vectors(filtered(questions(spark, sf))), relevant)
    asked = written(asked, "asked")
    systems = evaluation.standard_systems(c)
    systems = {n: s for n, s in systems.items() if names is None or n in names}
    hits = evaluation.run_systems(systems, asked)
    rows = evaluation.asked_by(
        systems, asked.select("query_id", "category", "age", "expected", "units")
    )
    return evaluation.score_runs(hits, rows, relevant)


SYSTEMS = (
    f"{BASE},{POSTINGS},{VECTORS},{dense_sql('d20', 'questions', 20)},{bm25_sql('b20', 'questions', 20)},"
    f"{hybrid_sql('hy', 'questions', 'true')},{rerank_sql('vr', 'd20', 'dense_rank')},{rerank_sql('hr', 'hy', 'rrf_rank')},"
    "known AS (SELECT * FROM questions WHERE age IS NOT NULL),"
    "known_p AS (SELECT * REPLACE (NULL::VARCHAR[] AS q_topics) FROM known),"
    f"{hybrid_sql('hp', 'known_p')},{rerank_sql('hpr', 'hp', 'rrf_rank')},"
    f"{relaxed_sql('ht', 'known')},{rerank_sql('htr', 'ht', 'rrf_rank')},{GOLD},"
    """runs AS (SELECT 'vector' AS system, query_id, chunk_id, dense_rank AS rank, dense_score AS top FROM d20
    UNION ALL SELECT 'bm25', query_id, chunk_id, bm25_rank, bm25_score FROM b20
    UNION ALL SELECT 'hybrid', query_id, chunk_id, rrf_rank, coalesce(dense_score, bm25_score, rrf_score) FROM hy
    UNION ALL SELECT 'vector+rerank', query_id, chunk_id, reranker_rank, reranker_score FROM vr
    UNION ALL SELECT 'hybrid+rerank', query_id, chunk_id, reranker_rank, reranker_score FROM hr
    UNION ALL SELECT 'hybrid+rerank+pop', query_id, chunk_id, reranker_rank, reranker_score FROM hpr
    UNION ALL SELECT 'hybrid+rerank+pop+topic', query_id, chunk_id, reranker_rank, reranker_score FROM htr),
    asked AS (SELECT unnest(['vector', 'bm25', 'hybrid', 'vector+rerank', 'hybrid+rerank']) AS system, * FROM questions
    UNION ALL SELECT unnest(['hybrid+rerank+pop', 'hybrid+rerank+pop+topic']), * FROM known),"""
    f"{metrics_sql('runs', 'asked')}"
)


@register(
    "system_comparison", "E1 E2 E3 A7 P19",
    f"{SYSTEMS} SELECT system, count(*) AS n, {MEANS} FROM per_q WHERE expected = 'answer' GROUP BY system",
)
def system_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.system_metrics(evaluated(spark, sf))


@register(
    "category_comparison", "E3 A25",
    f"{SYSTEMS} SELECT system, category, count(*) AS n, {MEANS} FROM per_q WHERE expected = 'answer' GROUP BY ALL",
)
def category_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.system_metrics(evaluated(spark, sf), ("system", "category"))


@register(
    "misses_at_five", "E3",
    f"{SYSTEMS} SELECT system, query_id, category, first FROM per_q WHERE expected = 'answer' AND hit_5 = 0",
)
def misses_at_five(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).where("expected = 'answer' and hit_5 = 0").select(
        "system", "query_id", "category", "first"
    )


def auroc_sql(others: str) -> str:
    return f"""(SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6)
      FROM tops a JOIN tops b USING (system) WHERE a.system = t.system AND a.expected = 'answer' AND b.expected IN ({others}))"""


@register(
    "abstention_signal", "A9 A10",
    f"""{SYSTEMS}, tops AS (SELECT p.system, CASE WHEN p.expected = 'abstain' AND p.query_id % 2 = 1 THEN 'clarify' ELSE p.expected END AS expected, round(r.top, 9) AS s FROM per_q p
      JOIN runs r ON r.system = p.system AND r.query_id = p.query_id AND r.rank = 1)
    SELECT system, count(*) FILTER (expected = 'answer') AS n_answer, count(*) FILTER (expected = 'abstain') AS n_abstain, count(*) FILTER (expected = 'clarify') AS n_clarify,
      {auroc_sql("'abstain'")} AS auroc_abstain, {auroc_sql("'abstain', 'clarify'")} AS auroc_both FROM tops t GROUP BY 1""",
)
def abstention_signal(spark: SparkSession, sf: str) -> DataFrame:
    """Questions without gold are to be abstained from; every second of them counts as unclear."""
    rows = evaluated(spark, sf).withColumn(
        "expected",
        F.when((F.col("expected") == "abstain") & (F.col("query_id") % 2 == 1), "clarify").otherwise(F.col("expected")),
    )
    return metrics.abstention_signal(written(rows.select("system", "expected", "top_score"), "tops"))


GAINS = [
    ("vector", "hybrid"), ("bm25", "hybrid"), ("vector+rerank", "hybrid+rerank"),
    ("hybrid+rerank", "hybrid+rerank+pop"), ("hybrid+rerank+pop", "hybrid+rerank+pop+topic"),
]


@register(
    "system_gains", "E3",
    f"""{SYSTEMS} SELECT a.system AS base, b.system AS other, count(*) AS n, round(avg(b.hit_5 - a.hit_5), 6) AS gain_hit_5,
      round(avg(b.rr - a.rr), 6) AS gain_rr, round(avg(b.ndcg_10 - a.ndcg_10), 6) AS gain_ndcg_10
    FROM per_q a JOIN per_q b USING (query_id) WHERE a.expected = 'answer' AND (a.system, b.system) IN ({", ".join(str(p) for p in GAINS)}) GROUP BY 1, 2""",
)
def system_gains(spark: SparkSession, sf: str) -> DataFrame:
    """What keyword search adds to vectors, and what each filter adds or costs."""
    return metrics.system_gains(evaluated(spark, sf), GAINS, ("hit_5", "rr", "ndcg_10"))


@register(
    "question_set_problems", "S11",
    """WITH q AS (SELECT 'q' || item_id % 37 AS query_id, ['answer', 'clarify', 'abstain', 'shrug', 'answer'][item_id % 5 + 1] AS expected, item_id % 3 AS gold FROM benchmark)
    SELECT DISTINCT query_id, problem FROM (
      SELECT query_id, 'expects something unknown' AS problem FROM q WHERE expected = 'shrug'
      UNION ALL SELECT query_id, 'answerable without evidence' FROM q WHERE expected = 'answer' AND gold = 0
      UNION ALL SELECT query_id, 'evidence without an answer' FROM q WHERE expected <> 'answer' AND gold > 0
      UNION ALL SELECT query_id, 'id used twice' FROM q GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT query_id, 'evidence names a document only' FROM q WHERE gold = 2)""",
)
def question_set_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items written as a question set, with faults put in, and read again."""
    b, k = table(spark, sf, "benchmark"), F.col("item_id")
    unit = F.struct(
        F.array(F.concat(F.lit("src"), k % 20)).alias("document_ids"),
        F.when(k % 3 == 1, F.array("text")).alias("must"),
    )
    expected = F.element_at(F.array(*[F.lit(e) for e in ("answer", "clarify", "abstain", "shrug", "answer")]), (k % 5 + 1).cast("int"))
    rows = b.select(
        F.concat(F.lit("q"), k % 37).alias("query_id"), F.col("text").alias("question"),
        expected.alias("expected"), F.when(k % 3 > 0, F.array(unit)).alias("gold"),
    )
    path = f"{shared_dir(spark)}/questions-{uuid.uuid4().hex}"
    write_lines(rows, path)
    return evalset.question_problems(evalset.read_questions(spark, path))


BOOT = 2000


def bootstrap_sql(rows: str, keys: str, unique: str, value: str) -> str:
    """(keys, mean, low, high) with the same md5 draws."""
    return f"""
slots AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY md5({unique}::VARCHAR)) - 1 AS slot,
    count(*) OVER (PARTITION BY {keys}) AS size FROM {rows}),
draws AS (SELECT {keys}, b, ('0x' || substring(md5('0|' || b || '|' || slot), 1, 8))::BIGINT % size AS slot
  FROM slots, range({BOOT}) t(b)),
means AS (SELECT {keys}, b, round(avg(v), 9) AS m FROM draws JOIN slots USING ({keys}, slot) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY m, b) - 1 AS i FROM means),
ends AS (SELECT {keys}, max(CASE WHEN i = {int(0.025 * BOOT)} THEN m END) AS low,
  max(CASE WHEN i = {int(0.975 * BOOT) - 1} THEN m END) AS high FROM ranked GROUP BY ALL)
SELECT {keys}, round(avg(v), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high
FROM slots JOIN ends USING ({keys}) GROUP BY {keys}"""


@register(
    "bootstrap_intervals", "A11 E3",
    f"{SYSTEMS}, answered AS (SELECT * FROM per_q WHERE expected = 'answer'),"
    + bootstrap_sql("answered", "system", "query_id", "rr"),
)
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(evaluated(spark, sf).where("expected = 'answer'"), "scores")
    found = stats.bootstrap_interval(rows, ["system"], "query_id", "rr", resamples=BOOT)
    return found.select("system", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@register(
    "paired_improvement", "A12 J10 U3 E3",
    f"""{SYSTEMS}, long AS (UNPIVOT (SELECT system, query_id, hit_5 AS hit_5, hit_10 AS hit_10, rr AS rr, ndcg_10 AS ndcg_10
      FROM per_q WHERE expected = 'answer') ON hit_5, hit_10, rr, ndcg_10 INTO NAME metric VALUE v),
    diffs AS (SELECT metric, query_id, b.v - a.v AS diff FROM long a JOIN long b USING (metric, query_id)
      WHERE a.system = 'hybrid' AND b.system = 'hybrid+rerank'),"""
    + bootstrap_sql("diffs", "metric", "query_id", "diff"),
)
def paired_improvement(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(evaluated(spark, sf, ["hybrid", "hybrid+rerank"]), "scores")
    found = stats.paired_delta(
        rows, "hybrid", "hybrid+rerank", ["hit_5", "hit_10", "rr", "ndcg_10"], resamples=BOOT
    )
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@register(
    "gold_validation", "A13 P9 S11",
    f"""WITH {CHUNKS},{GOLD} SELECT item_id AS query_id, 0 AS unit_index,
      CASE WHEN n = 0 THEN 'error' ELSE 'warning' END AS severity,
      CASE WHEN n = 0 THEN 'matches no chunk in the corpus' ELSE 'matches ' || n || ' chunks (> 40): too broad?' END AS message
    FROM (SELECT item_id, coalesce(total, 0) AS n FROM benchmark LEFT JOIN totals ON query_id = item_id)
    WHERE n = 0 OR n > 40""",
)
def gold_validation(spark: SparkSession, sf: str) -> DataFrame:
    units = questions(spark, sf).select("query_id", F.lit(0).alias("unit_index"))
    return metrics.validate_gold(gold(spark, sf).withColumn("unit_index", F.lit(0)), units)


@register(
    "caller_filters", "P2 P3 P4 P5 P6 U3",
    f"""WITH {QUESTIONS} SELECT query_id, array_to_string(q_population, ',') AS populations, array_to_string(q_topics, ',') AS topics,
      q_population IS NULL AND q_topics IS NULL AS is_empty, q_topics IS NOT NULL AS relaxing_helps,
      query_id % 4 = 3 AS pregnant FROM questions""",
)
def caller_filters(spark: SparkSession, sf: str) -> DataFrame:
    q = filtered(questions(spark, sf))
    relaxed = filters.relax(q)
    checked = q.join(relaxed.select("query_id", filters.is_empty(relaxed.columns).alias("_r")), "query_id")
    return checked.select(
        "query_id",
        F.array_join("q_population", ",").alias("populations"),
        F.array_join("q_topics", ",").alias("topics"),
        filters.is_empty(q.columns).alias("is_empty"),
        filters.relaxing_helps(q.columns).alias("relaxing_helps"),
        filters.is_pregnant(F.col("pregnancy")).alias("pregnant"),
    )


@register(
    "embedding_hashes", "H10 H11 S13",
    f"""WITH {CHUNKS} SELECT chunk_id, sha1(chunk_id::VARCHAR) AS point_id,
      sha1('hashed-words-64' || chr(10) || document_id || ' > ' || document_id || chr(10) || text) AS content_hash
    FROM chunks""",
)
def embedding_hashes(spark: SparkSession, sf: str) -> DataFrame:
    text = embedding_text(F.col("document_title"), F.col("heading_path"), F.col("text"))
    return chunks(spark, sf).where("retrievable").select(
        "chunk_id",
        point_id(F.col("chunk_id").cast("string")).alias("point_id"),
        content_hash("hashed-words-64", text).alias("content_hash"),
    )


@register("document_embeddings", "F2",
    f"WITH {CHUNKS},{VECTORS} SELECT chunk_id, slot, round(x, 6) AS x FROM cv")
def document_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    text = embedding_text(F.col("document_title"), F.col("heading_path"), F.col("text"))
    vectors = chunks(spark, sf).where("retrievable").select(
        "chunk_id", F.posexplode(hashed_words(text)).alias("slot", "x")
    )
    return vectors.where("x > 0").select(
        "chunk_id", F.col("slot").cast("bigint").alias("slot"), F.round("x", 6).alias("x")
    )
