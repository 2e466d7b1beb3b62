"""Connected components of a graph too large for one machine, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label: one row for each end of an edge; equal labels are connected.

    Each round every node picks, among itself and its neighbours, the one that comes first in
    an order drawn anew for the round, and edges are moved to the picked nodes. Stars shrink to
    a point at once and chains by a constant factor on average, so the rounds are few. The picks
    of all rounds are then followed from the first.
    """
    left = stored(
        edges.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        ).where("a <> b").distinct(),
        "edges",
    )
    labels = None
    number = 0
    while left.limit(1).count():
        drawn = lambda c, n=number: F.xxhash64(F.lit(n), c)
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        first = F.min(F.struct(drawn(F.col("to")).alias("draw"), F.col("to").alias("to")))
        picks = stored(
            both.groupBy("node").agg(first.alias("first")).select(
                "node",
                F.when(
                    F.struct(drawn(F.col("node")), F.col("node")) < F.col("first"), F.col("node")
                )
                .otherwise(F.col("first.to"))
                .alias("label"),
            ),
            "picks",
        )
        moved = (
            left.join(picks.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
            .join(picks.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct()
        )
        left = stored(moved, "edges")
        if labels is None:
            labels = picks
        else:
            after = picks.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = stored(
                labels.join(after, "label", "left").select(
                    "node", F.coalesce("next", "label").alias("label")
                ),
                "labels",
            )
        number += 1
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
