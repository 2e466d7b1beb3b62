"""Statistics over per-question or per-sample rows, exact at any group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.ids import draw
from quillon.scale import block_scan, by_value_scan, exact_percentiles, join_small


def latency_summary(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, mean, p50, p95, p99 and max of each key."""
    keys = list(keys)
    plain = samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    ranks = exact_percentiles(samples, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return plain.join(ranks, keys)


def auroc(scored: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """P(positive scores higher) + half of the ties, from cumulative counts of each score."""
    keys = list(keys)
    counts = scored.groupBy(*keys, score).agg(
        F.sum(F.col(positive).cast("bigint")).alias("_pos"),
        F.sum((~F.col(positive)).cast("bigint")).alias("_neg"),
    )
    below = by_value_scan(counts, keys, score, _lower=("sum_before", "_neg"))
    return below.groupBy(*keys).agg(
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
        (
            F.sum(F.col("_pos") * (F.col("_lower") + F.col("_neg") / 2.0))
            / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))
        ).alias("auroc"),
    ).where("n_pos > 0 and n_neg > 0")


def numbered(df: DataFrame, keys: Sequence[str], unique: str, name: str = "slot") -> DataFrame:
    """Rows of each key numbered from 0 in the order of the md5 of ``unique``."""
    hashed = df.withColumn("_md5", F.md5(F.col(unique).cast("string")))
    placed = block_scan(
        hashed, keys, F.substring("_md5", 1, 2), ["_md5"],
        **{name: ("sum_before", F.lit(1)), "size": ("total", F.lit(1))},
    )
    return placed.drop("_md5")


def bootstrap_interval(
    values: DataFrame, keys: Sequence[str], unique: str, value: str,
    *, resamples: int = 2000, seed: int = 0, alpha: float = 0.05,
) -> DataFrame:
    """Percentile bootstrap of the mean: (mean, low, high) for each key.

    Draw i of resample b takes row md5(seed|b|i) mod n, so the result does not depend on
    partitioning. The interval's ends are the reference's order statistics.
    """
    keys = list(keys)
    slots = numbered(values, keys, unique).select(*keys, "slot", "size", value)
    draws = slots.select(
        *keys, "slot", "size",
        F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_b"),
    ).withColumn("slot", draw(str(seed), F.col("_b"), F.col("slot")) % F.col("size"))
    # Many draws of one slot become one row with a count before they meet the value.
    drawn = draws.groupBy(*keys, "_b", "slot").agg(F.count(F.lit(1)).alias("_times"), F.first("size").alias("size"))
    picked = join_small(
        drawn, slots.select(*keys, "slot", value), [*keys, "slot"], ["_b"]
    )
    means = picked.groupBy(*keys, "_b").agg(
        F.round(F.sum(F.col(value) * F.col("_times")) / F.first("size"), 9).alias("_mean")
    )
    counts = means.groupBy(*keys, "_mean").agg(F.count(F.lit(1)).alias("_n"))
    placed = by_value_scan(counts, keys, "_mean", _from=("sum_before", "_n"))

    def at(index: int) -> Column:
        inside = (F.col("_from") <= index) & (F.col("_from") + F.col("_n") > index)
        return F.max(F.when(inside, F.col("_mean")))

    ends = placed.groupBy(*keys).agg(
        at(int(alpha / 2 * resamples)).alias("low"),
        at(int((1 - alpha / 2) * resamples) - 1).alias("high"),
    )
    return values.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ends, keys)


def paired_differences(
    per_question: DataFrame, base: str, other: str, metrics: Sequence[str]
) -> DataFrame:
    """(metric, query_id, diff) over the questions both systems answered."""
    answered = per_question.where("expected = 'answer'")
    stacked = answered.select(
        "system", "query_id",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
        ).alias("_m"),
    ).select("system", "query_id", "_m.metric", "_m.v")
    return (
        stacked.where(F.col("system").isin(base, other))
        .groupBy("metric", "query_id")
        .agg(
            F.max(F.when(F.col("system") == base, F.col("v"))).alias("_a"),
            F.max(F.when(F.col("system") == other, F.col("v"))).alias("_b"),
        )
        .where("_a is not null and _b is not null")
        .select("metric", "query_id", (F.col("_b") - F.col("_a")).alias("diff"))
    )


def paired_delta(
    per_question: DataFrame, base: str, other: str, metrics: Sequence[str], **options: int
) -> DataFrame:
    """Mean difference with its interval; at least two common questions are needed."""
    diffs = paired_differences(per_question, base, other, metrics)
    enough = diffs.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return bootstrap_interval(diffs, ["metric"], "query_id", "diff", **options).join(
        enough, "metric"
    )


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95% interval of a share, kept inside [0, 1]; (0, 0) for an empty total."""
    share = hits / total
    middle = share + F.lit(z * z) / (2 * total)
    spread = z * F.sqrt(share * (1 - share) / total + F.lit(z * z) / (4 * total * total))
    scale = 1 + F.lit(z * z) / total
    low = F.when(total > 0, F.greatest(F.lit(0.0), (middle - spread) / scale)).otherwise(0.0)
    high = F.when(total > 0, F.least(F.lit(1.0), (middle + spread) / scale)).otherwise(0.0)
    return low, high


