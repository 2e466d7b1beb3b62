"""What an ingest run made of each document: sizes, sections, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.stats import latency_summary

TOP_TOPICS = 5


def _tally(chunks: DataFrame, label: str, missing: str, name: str, most: int | None = None) -> DataFrame:
    """(document_id, <name>): counts of a label as ``label=n``, by label or, for the ``most``
    frequent ones, by falling count."""
    counts = (
        chunks.groupBy("document_id", F.coalesce(F.col(label), F.lit(missing)).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    falling = -F.col("n") if most is not None else F.lit(0)
    order = Window.partitionBy("document_id").orderBy(falling, "label")
    placed = counts.withColumn("at", F.row_number().over(order))
    if most is not None:
        placed = placed.where(F.col("at") <= most)
    shown = F.struct("at", F.concat_ws("=", "label", "n").alias("text"))
    return placed.groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["text"]), ",").alias(name)
    )


def document_report(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each document of ``pages(document_id, pages)``, with chunks or without.

    ``chunks(document_id, chunk_id, heading_path, token_count, retrievable, chunk_type, population,
    topic)``. Label counts are text: a document has few labels. Percentiles of the token counts are
    exact whatever a document's size.
    """
    counts = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count(F.when(F.col("retrievable"), 1)).alias("retrievable"),
        F.count_distinct(F.to_json("heading_path")).alias("sections"),
    )
    sizes = latency_summary(chunks, ["document_id"], "token_count").select(
        "document_id",
        *(F.round(p, 1).alias(f"tokens_{p}") for p in ("p50", "p95")),
        F.col("max").cast("bigint").alias("tokens_max"),
    )
    out = pages.join(counts, "document_id", "left").join(sizes, "document_id", "left")
    for label, missing, name, most in (
        ("chunk_type", "none", "chunk_types", None),
        ("population", "unknown", "populations", None),
        ("topic", "none", "top_topics", TOP_TOPICS),
    ):
        out = out.join(_tally(chunks, label, missing, name, most), "document_id", "left")
    zeros = ["chunks", "retrievable", "sections", "tokens_max"]
    return out.fillna(0, [*zeros, "tokens_p50", "tokens_p95"]).fillna(
        "", ["chunk_types", "populations", "top_topics"]
    )


def totals(report: DataFrame) -> DataFrame:
    """The whole run in one row."""
    return report.agg(
        F.count(F.lit(1)).alias("documents"),
        *(F.sum(c).alias(c) for c in ("pages", "sections", "chunks", "retrievable")),
    )
