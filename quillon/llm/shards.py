"""Sharding by jump consistent hashing: stable keys go to shards without a ring table.

A key's pseudo-random stream decides a growing list of jump targets; the shard among ``n`` is
the last target below ``n``. Appending a shard therefore moves a key only if its stream jumps
exactly into the new shard. The stream is ``xxhash64(key, step)``, so everything is column
expressions.

Defined results: a null key is a key of its own (all null keys share a shard); a null text has
size 16 and the checksum of no bytes; repeated rows share a shard and get slots of their own;
an empty table gives no rows; further columns are kept unless they bear a result's name, in
which case the result replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_BYTES = 16
SLICES = 64
TOP = float(1 << 31)


def jump_shards(key: Column, *counts: int) -> Column:
    """A struct with one field ``of_<n>`` for each number of shards: the key's shard among n."""
    if not counts or min(counts) < 1:
        raise ValueError("counts of shards start at 1")
    stable = F.coalesce(key.cast("string"), F.lit("\x00null"))
    most = max(counts)

    def follow(state: Column, step: Column) -> Column:
        here = state["at"]
        # The upper 31 bits of the step's draw, as a fraction in (0, 1].
        draw = F.shiftrightunsigned(F.xxhash64(stable, step), 33)
        target = F.floor((here + 1) * (F.lit(TOP) / (draw + 1).cast("double")))
        running = here < most
        return F.struct(
            F.when(running, F.least(target, F.lit(most).cast("bigint")))
            .otherwise(here)
            .alias("at"),
            *(
                F.when(running & (target < n), target.cast("int"))
                .otherwise(state[f"of_{n}"])
                .alias(f"of_{n}")
                for n in counts
            ),
        )

    start = F.struct(
        F.lit(0).cast("bigint").alias("at"), *(F.lit(0).cast("int").alias(f"of_{n}") for n in counts)
    )
    # Each step moves up by one at least, so ``most`` steps always reach the end.
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, follow)


def shard_documents(
    docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with size, text_crc32, shard, slot (gapless from 0 in each shard), grown_shard.

    Slots are given in two steps, so no shard is ever one task: rows are counted and ranked in
    slices of a shard, and a slice begins where the counts of those before it end.
    """
    own = ["size", "text_crc32", "shard", "grown_shard", "slot"]
    kept = [c for c in docs.columns if c.lower() not in own]
    # Working columns get names that no column of the input has.
    mark = "_"
    while any(c.lower().startswith(f"{mark}jump") or c.lower().startswith(f"{mark}at_") for c in kept):
        mark += "_"
    jump, slice_, n, begin, row = (f"{mark}{x}" for x in ("jump", "at_slice", "at_n", "at_begin", "at_row"))
    bytes_ = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    placed = docs.select(
        *kept,
        (bytes_ + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_shards(F.col(key), shards, shards + 1).alias(jump),
    ).select(
        "*",
        F.col(f"{jump}.of_{shards}").alias("shard"),
        F.col(f"{jump}.of_{shards + 1}").alias("grown_shard"),
        F.pmod(F.xxhash64(key, "text_crc32"), F.lit(SLICES)).cast("int").alias(slice_),
    ).drop(jump)
    # At most shards x SLICES rows, so the running sum is small whatever the table's size.
    counts = placed.groupBy("shard", slice_).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy("shard").orderBy(slice_).rowsBetween(
        Window.unboundedPreceding, -1
    )
    begins = counts.select(
        "shard", slice_, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(begin)
    )
    inside = Window.partitionBy("shard", slice_).orderBy(key, "text_crc32", "size")
    return (
        placed.withColumn(row, F.row_number().over(inside) - 1)
        .join(F.broadcast(begins), ["shard", slice_])
        .withColumn("slot", (F.col(begin) + F.col(row)).cast("bigint"))
        .select(*kept, *own)
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order inside its files."""
    (
        sharded.repartition("shard", F.floor(F.col("slot") / 100_000))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
