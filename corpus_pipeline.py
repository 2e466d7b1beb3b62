"""The corpus pipeline: what a raw document table goes through before training.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it has kept.
All but the last return the columns of ``documents``. Rows are judged and dropped one by one,
whether their ids are null, used twice or their own. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, leaks, pieces, quality, suffixes
from quillon.llm.shared import stored
from quillon.llm.suite import PIECE_MODEL
from quillon.scale import fits_broadcast
from quillon.suite.base import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def row_name(docs: DataFrame) -> str:
    """A column name that ``docs`` does not have, whatever the case."""
    name, taken = "_row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written once: read again, it is the same; its name."""
    name = row_name(docs)
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without(rows: DataFrame, gone: DataFrame, number: str) -> DataFrame:
    """Numbered rows less those of ``gone``; broadcast only behind a measured size."""
    numbers = stored(gone.select(number).distinct(), "gone")
    side = F.broadcast(numbers) if fits_broadcast(numbers) else numbers
    return rows.join(side, number, "left_anti").drop(number)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rows, row = numbered(docs)
    judged = quality.classify(rows, table(spark, sf_dir, "labels"), row=row)
    return without(rows, judged.where(~F.col("kept")), row)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the least id stays (null last)."""
    rows, row = numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)
    classes = jaccard.similar_documents(rows.select(key.alias("_key"), "text"), key="_key")
    later = F.col("doc_id")[row] != F.col("class_id")[row]
    return without(rows, classes.where(later).select(F.col("doc_id")[row].alias(row)), row)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the texts.

    The numbers that order rows of one id are written with the texts before they are used.
    """
    row = row_name(docs)
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    done = suffixes.remove_repeats(rows, row=row)
    replaced = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return done.select(
        *(replaced[c].alias(c) if c in replaced else F.col(c) for c in docs.columns)
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    rows, row = numbered(docs)
    found = leaks.contained_items(rows, table(spark, sf_dir, "benchmark"), key=row)
    return without(rows, found.select(F.col("doc_id").alias(row)), row)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each text, and the digest of the text decoded from them."""
    return pieces.round_trip(docs, public_tokenizers.path(PIECE_MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

# The classifier and the tokenizer have no SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
