"""Question sets for the evaluation: a reader, and the checks a set must pass before it is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = (
    "struct<document_ids: array<string>, page_lo: int, page_hi: int, sections: array<string>, "
    "must: array<string>, any_of: array<string>>"
)
QUESTIONS = (
    "query_id string, category string, question string, retrieval_query string, age int, "
    f"pregnancy string, expected string, gold array<{UNIT}>"
)
# --- fixed values: what a question may expect ------------------------------------------------
EXPECTED = ("answer", "clarify", "abstain")
# --- end of fixed values ---------------------------------------------------------------------


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines question set with declared types; a question expects an answer by default."""
    rows = spark.read.schema(QUESTIONS).json(path)
    return rows.withColumn("expected", F.coalesce("expected", F.lit("answer"))).withColumn(
        "text", F.coalesce("retrieval_query", "question")
    )


def gold_units(questions: DataFrame) -> DataFrame:
    """(query_id, unit_index, <unit columns>): the evidence each question needs."""
    rows = questions.select("query_id", F.posexplode("gold").alias("unit_index", "_u"))
    return rows.select("query_id", "unit_index", "_u.*")


def _some(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def question_problems(questions: DataFrame) -> DataFrame:
    """(query_id, problem): ids used twice, unknown expectations, evidence that is missing or
    out of place, and evidence that no more than names a document."""
    has_gold = _some("gold")
    expected = F.col("expected")
    named = {
        "expects something unknown": ~F.coalesce(expected.isin(*EXPECTED), F.lit(False)),
        "answerable without evidence": (expected == "answer") & ~has_gold,
        "evidence without an answer": (expected != "answer") & has_gold,
    }
    own = [
        questions.where(test).select("query_id", F.lit(name).alias("problem"))
        for name, test in named.items()
    ]
    twice = (
        questions.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("query_id", F.lit("id used twice").alias("problem"))
    )
    bound = F.col("page_lo").isNotNull() | _some("sections") | _some("must") | _some("any_of")
    loose = (
        gold_units(questions)
        .where(~bound)
        .select("query_id", F.lit("evidence names a document only").alias("problem"))
    )
    return reduce(DataFrame.unionByName, [*own, twice, loose]).distinct()


def checked_questions(questions: DataFrame) -> DataFrame:
    """``questions`` if nothing is wrong with them, else an error that names the first problems."""
    found = question_problems(questions).orderBy("query_id", "problem").limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.query_id}: {r.problem}" for r in found))
    return questions
