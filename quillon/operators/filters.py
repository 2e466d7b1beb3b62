"""Metadata filters: which chunks a query may see.

A query row carries one array for each field (``q_population``...); null or empty means no
restriction. Within a field any value may match, across fields all must.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.labels import infer_topics

FILTER_COLUMNS = ("population", "topics", "document_type", "document_id", "chunk_type")
ADULT_FROM = 18


def _unset(column: str) -> Column:
    return F.coalesce(F.size(F.col(column)), F.lit(0)) <= 0


def _matches(name: str) -> Column:
    wanted = F.col(f"q_{name}")
    if name == "topics":
        return F.coalesce(F.arrays_overlap(wanted, F.col(name)), F.lit(False))
    return F.coalesce(F.array_contains(wanted, F.col(name)), F.lit(False))


def passes(columns: Collection[str]) -> Column:
    """The filter over rows that hold both the query's arrays and the chunk's labels."""
    out = F.col("retrievable") if "retrievable" in columns else F.lit(True)
    for name in FILTER_COLUMNS:
        if name in columns and f"q_{name}" in columns:
            out = out & (_unset(f"q_{name}") | _matches(name))
    return out


def is_empty(columns: Collection[str]) -> Column:
    out = F.lit(True)
    for name in FILTER_COLUMNS:
        if f"q_{name}" in columns:
            out = out & _unset(f"q_{name}")
    return out


def relax(queries: DataFrame) -> DataFrame:
    """Only the population stays: it says whom the answer is for."""
    for name in FILTER_COLUMNS:
        column = f"q_{name}"
        if name != "population" and column in queries.columns:
            queries = queries.withColumn(
                column, F.lit(None).cast(queries.schema[column].dataType)
            )
    return queries


def relaxing_helps(columns: Collection[str]) -> Column:
    """Some field other than the population is set."""
    out = F.lit(False)
    for name in FILTER_COLUMNS:
        if name != "population" and f"q_{name}" in columns:
            out = out | ~_unset(f"q_{name}")
    return out


def is_pregnant(status: Column) -> Column:
    s = F.lower(status)
    denied = s.rlike("^(?:no|not )") | F.contains(s, F.lit(" not ")) | F.contains(s, F.lit("n't"))
    said = F.contains(s, F.lit("pregnan")) | s.isin("yes", "true", "y")
    return F.coalesce((s != "") & ~denied & said, F.lit(False))


def population_for(age: Column, pregnancy: Column | None = None) -> Column:
    base = F.when(age < ADULT_FROM, F.array(F.lit("child"), F.lit("all"))).when(
        age >= ADULT_FROM, F.array(F.lit("adult"), F.lit("all"))
    )
    if pregnancy is None:
        return base
    return F.when(is_pregnant(pregnancy), F.concat(base, F.array(F.lit("pregnancy")))).otherwise(
        base
    )


def topics_for(*texts: Column) -> Column:
    """Topics inferred from the complaint and symptoms, null if none."""
    found = infer_topics(F.concat_ws(" ", *texts))
    return F.when(F.size(found) > 0, found)


def from_intake(
    intake: DataFrame, words: list[str], *, age: str = "age", pregnancy: str = "pregnancy",
    include_topics: bool = True,
) -> DataFrame:
    """Adds ``q_population`` and ``q_topics`` to rows of what callers have said."""
    out = intake.withColumn("q_population", population_for(F.col(age), F.col(pregnancy)))
    topics = topics_for(*[F.col(w) for w in words]) if include_topics else F.lit(None)
    return out.withColumn("q_topics", topics.cast("array<string>"))


CORE_FIELDS = ("chief_complaint", "duration", "severity")
ESCALATING = ("urgent", "emergency")


def missing_fields(fields: Collection[str] = CORE_FIELDS) -> Column:
    """Names of the fields that are still unanswered."""
    return F.filter(
        F.array(
            *[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields]
        ),
        lambda name: name.isNotNull(),
    )


def must_escalate(urgency: Column, flagged: Column) -> Column:
    """An urgent or emergency assessment always escalates, whatever it was flagged."""
    return F.coalesce(flagged, F.lit(False)) | urgency.isin(*ESCALATING)


def valid_confidence(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0.0, 1.0), F.lit(False))
