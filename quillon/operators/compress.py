"""Extractive compression: of a passage, keep what answers the question and every caution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import let, split_units, word_count
from quillon.operators.dense import hashed_words

# --- fixed values: cues that are always kept, and the mark of an omission --------------------
SAFETY_CUE = (
    r"(?iU)\b(?:do not|don't|never|must not|should not|avoid|contraindicat\w*|not recommended|"
    r"danger signs?|red flags?|refer(?:ral)?\b|urgent(?:ly)?|emergency|immediately|"
    r"life[- ]threatening|warning|caution|toxic\w*|only if|unless)\b"
)
OMISSION = "…"
# --- end of fixed values ---------------------------------------------------------------------


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def compress(passages: DataFrame, budget: int = 200, embedder=hashed_words, count=word_count) -> DataFrame:
    """``passages(query_id, chunk_id, query_text, text)`` with ``compressed`` and the kept counts.

    The first unit, a table's header and every caution are kept on top of the budget, which is
    spent on the other units by likeness to the question; one too large is passed over. Units
    keep their order. Short passages stay whole.
    """
    base = passages.withColumn("units", split_units(F.col("text"))).withColumn("tokens", count(F.col("text")))
    table = F.startswith(F.get("units", F.lit(0)), F.lit("|"))
    header = F.when(table, F.size(F.filter(F.slice("units", 1, 2), lambda u: F.startswith(u, F.lit("|"))))).otherwise(0)
    rows = base.where((F.col("tokens") > budget) & (F.size("units") > 2)).select(
        "query_id", "chunk_id", embedder(F.col("query_text")).alias("_q"), header.alias("_header"),
        F.posexplode("units").alias("i", "unit"),
    )
    rows = rows.withColumn("_v", embedder(F.col("unit")))
    forced = (F.col("i") == 0) | (F.col("i") < F.col("_header")) | F.col("unit").rlike(SAFETY_CUE)
    scored = rows.select(
        "query_id", "chunk_id", "i",
        F.struct(
            (-F.round(_dot("_q", "_v"), 9)).alias("by"), "i", count(F.col("unit")).alias("cost"),
            forced.alias("forced"),
        ).alias("_u"),
    )
    # The units of one passage: a bounded list.
    listed = scored.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list("_u")).alias("_us"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))

    def spend(acc: Column, u: Column) -> Column:
        fits = acc["used"] + u["cost"] <= budget
        return (
            F.when(u["forced"], F.struct(acc["used"].alias("used"), F.array_append(acc["kept"], u["i"]).alias("kept")))
            .when(fits, F.struct((acc["used"] + u["cost"]).alias("used"), F.array_append(acc["kept"], u["i"]).alias("kept")))
            .otherwise(acc)
        )

    kept = listed.select(
        "query_id", "chunk_id", F.array_sort(F.aggregate("_us", start, spend)["kept"]).alias("kept")
    )
    out = base.join(kept, ["query_id", "chunk_id"], "left")
    total = F.size("units")

    def shown(ids: Column) -> Column:
        lines = F.transform(
            ids,
            lambda i, n: F.concat(
                F.when((n > 0) & (F.get(ids, n - 1) != i - 1), OMISSION + "\n").otherwise(""),
                F.get(F.col("units"), i),
            ),
        )
        tail = F.when(F.element_at(ids, -1) != total - 1, "\n" + OMISSION).otherwise("")
        return F.concat(F.array_join(lines, "\n"), tail)

    whole = F.col("kept").isNull() | (F.size("kept") == total)
    out = out.withColumn("compressed", F.when(whole, F.col("text")).otherwise(let(F.col("kept"), shown)))
    return out.select(
        *passages.columns, "compressed", F.col("tokens").alias("original_tokens"),
        count(F.col("compressed")).alias("kept_tokens"),
        F.when(whole, total).otherwise(F.size("kept")).alias("kept_units"), total.alias("total_units"),
    )
