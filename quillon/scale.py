"""Building blocks that keep a job whole when one key holds a large share of the rows.

* ``block_scan``: running values (fill, lag, running sum...) along an ordered key without
  putting the whole key into one task. Rows are windowed inside (key, block); one summary
  row for each block carries the state across.
* ``by_value_scan``: the same along the values of a column, with blocks cut at approximate
  quantiles, for exact ranks and percentiles of a hot key.
* ``measured`` / ``join_small``: broadcast behind a measured size, salted join beyond it;
  ``join_shuffled``: never a broadcast; ``join_in_place``: wide rows stay where they are stored.
* ``greedy_runs``: left-to-right greedy grouping (fill a run until it is full) over a long
  sequence, solved block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import written

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16
BUCKETS = 64


def spread(df: DataFrame, task_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """A small input that would be read by fewer tasks than there are cores, dealt out evenly.

    Judged by the planner's size estimate alone; large inputs are left as they are stored.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * task_bytes else df


# --- joins ---------------------------------------------------------------------------------


def _wide(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value; nested values by what they hold, nulls as a word."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 8
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            size = F.aggregate(value, F.lit(8), lambda n, x: (n + _wide(x, kind.elementType)).cast("int"))
        else:
            size = F.size(value) * 8 + 8
    elif isinstance(kind, T.MapType):
        size = _wide(F.map_keys(value), T.ArrayType(kind.keyType)) + _wide(
            F.map_values(value), T.ArrayType(kind.valueType)
        )
    elif isinstance(kind, T.StructType):
        size = F.lit(8)
        for field in kind.fields:
            size = size + _wide(value[field.name], field.dataType)
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(8))


def measured_bytes(df: DataFrame) -> int:
    """Bytes the rows of ``df`` take, counted by a small aggregation job."""
    per_row: Column = F.lit(8)
    for field in df.schema.fields:
        per_row = per_row + _wide(F.col(f"`{field.name}`"), field.dataType)
    return int(df.agg(F.coalesce(F.sum(per_row.cast("bigint")), F.lit(0))).first()[0])


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return measured_bytes(df) <= limit


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    *,
    how: str = "inner",
    fits: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to a side expected to be small, whatever its real size.

    Broadcast if the measured size allows it. Otherwise a salted shuffle join: each row of
    ``big`` goes to one of ``salts`` copies of its key (chosen by its ``spread`` columns), so
    a key that holds a third of ``big`` is split over that many tasks.
    """
    on = list(on)
    if fits if fits is not None else fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.withColumn("_salt", F.col("_salt").cast("bigint"))
    return join_shuffled(salted, copies, [*on, "_salt"], how).drop("_salt")


def join_shuffled(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join of two sides that grow, always by a shuffle.

    The planner goes by the size of stored files and would broadcast a side that takes many
    times that size in the driver.
    """
    return left.join(right.hint("merge"), [on] if isinstance(on, str) else list(on), how)


def join_in_place(wide: DataFrame, small: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner join that moves no row of ``wide``, such as whole texts: a shuffle may hold all that a
    task reads, and a merge sorts it. ``small`` comes to them, in blocks of a checked size."""
    small = written(small, "small")
    blocks = -(-measured_bytes(small) // BROADCAST_BYTES) or 1
    number = F.pmod(F.xxhash64(*small.columns), F.lit(blocks))
    parts = [
        wide.join(F.broadcast(small.where(number == block)), [on] if isinstance(on, str) else list(on))
        for block in range(blocks)
    ]
    return reduce(DataFrame.unionByName, parts)


# --- running values along an ordered key -----------------------------------------------------


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: Column | str,
    order: Sequence[str],
    **specs: tuple[str, Column | str],
) -> DataFrame:
    """Add running columns to ``df``; ``specs`` maps a new name to (kind, column).

    Kinds: ``fill`` last non-null value up to and including the row; ``before`` last non-null
    value strictly before it; ``sum`` / ``sum_before`` running sum with and without the row;
    ``max`` running maximum; ``total`` the key's total. ``order`` must be unique within the
    key and ``block`` must not decrease along it.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_block", block if isinstance(block, Column) else F.col(block))
    names = {name: f"_v_{name}" for name in specs}
    for name, (_, value) in specs.items():
        rows = rows.withColumn(names[name], value if isinstance(value, Column) else F.col(value))

    here = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = here.rowsBetween(Window.unboundedPreceding, -1)
    across = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*keys)
    at = F.struct(*order)

    summary, carry, local = [], [], []
    for name, (kind, _) in specs.items():
        value = F.col(names[name])
        block_value = F.col(f"_b_{name}")
        if kind in ("fill", "before"):
            summary.append(F.max_by(value, F.when(value.isNotNull(), at)).alias(f"_b_{name}"))
            carry.append(F.last(block_value, ignorenulls=True).over(across).alias(f"_c_{name}"))
            local.append(
                F.last(value, ignorenulls=True)
                .over(upto if kind == "fill" else prior)
                .alias(f"_l_{name}")
            )
        elif kind in ("sum", "sum_before", "total"):
            summary.append(F.sum(value).alias(f"_b_{name}"))
            over = whole if kind == "total" else across
            carry.append(F.sum(block_value).over(over).alias(f"_c_{name}"))
            if kind != "total":
                local.append(
                    F.sum(value).over(upto if kind == "sum" else prior).alias(f"_l_{name}")
                )
        elif kind == "max":
            summary.append(F.max(value).alias(f"_b_{name}"))
            carry.append(F.max(block_value).over(across).alias(f"_c_{name}"))
            local.append(F.max(value).over(upto).alias(f"_l_{name}"))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    carried = (
        rows.groupBy(*keys, "_block")
        .agg(*summary)
        .select(*keys, "_block", *carry)
    )
    out = rows.select("*", *local).join(carried, [*keys, "_block"], "left")
    for name, (kind, _) in specs.items():
        here_value, from_before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind in ("fill", "before"):
            result = F.coalesce(here_value, from_before)
        elif kind == "total":
            result = from_before
        elif kind == "max":
            result = F.greatest(here_value, from_before)
        else:
            result = F.coalesce(here_value, F.lit(0)) + F.coalesce(from_before, F.lit(0))
        out = out.withColumn(name, result)
    drop = ["_block", *(f"_{p}_{n}" for n in specs for p in ("v", "l", "c"))]
    return out.drop(*drop)


def by_value_scan(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    buckets: int = BUCKETS,
    **specs: tuple[str, Column | str],
) -> DataFrame:
    """``block_scan`` along ``value``, for one row per (keys, value).

    Blocks are cut at approximate quantiles of each key, so they are even whatever the
    distribution. The cut points only decide where the work is done, never the result.
    """
    keys = list(keys)
    # The counts feed the cuts and both halves of the scan: they are made once.
    counts = written(counts, "counts")
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx(
            value, [i / buckets for i in range(1, buckets)], F.lit(buckets * 20)
        ).alias("_cuts")
    )
    placed = join_small(counts, cuts, keys, [value], how="left").withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda cut: cut < F.col(value)))
    )
    return block_scan(placed, keys, "_bucket", [value], **specs).drop("_bucket", "_cuts")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Linear-interpolated percentiles for each key, exact at any group size."""
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = by_value_scan(counts, keys, value, _from=("sum_before", "_n"), _all=("total", "_n"))
    picks = []
    for name, p in probabilities.items():
        target = (F.col("_all") - 1) * F.lit(p)
        for end, index in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            inside = (index >= F.col("_from")) & (index < F.col("_from") + F.col("_n"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{end}"))
        picks.append(F.max(target - F.floor(target)).alias(f"_{name}_part"))
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *(
            (
                F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")
            ).alias(n)
            for n in probabilities
        ),
    )


# --- greedy grouping of a long sequence ------------------------------------------------------


def greedy_runs(
    items: DataFrame,
    keys: Sequence[str],
    seq: str,
    payload: Sequence[str],
    run_end: Callable[[dict[str, list], int], int],
    lookahead: int,
    *,
    block_rows: int = 4096,
    name: str = "runs",
) -> DataFrame:
    """Number the runs that filling from the left makes: adds ``run_start`` (0/1).

    ``seq`` counts 0, 1, 2... within each key. ``run_end(columns, i)`` returns the position after
    the last row of the run that starts at position ``i`` of the columns; it may look at row
    ``i - 1`` and at most ``lookahead`` rows ahead. Where a run starts decides where it ends,
    so each block first works out, for every way a run may enter it, how it is left; chaining
    these small tables gives each block its true entry, and the blocks are then solved alone.
    """
    keys, payload = list(keys), list(payload)
    if lookahead >= block_rows:
        raise ValueError("block_rows must be larger than lookahead")
    thin = items.select(*keys, seq, *payload).withColumn(
        "_block", F.floor(F.col(seq) / block_rows).cast("bigint")
    )
    offset = F.col(seq) - F.col("_block") * block_rows
    homes = F.array(
        F.col("_block"),
        F.when((offset <= lookahead) & (F.col("_block") > 0), F.col("_block") - 1),
        F.when(offset == block_rows - 1, F.col("_block") + 1),
    )
    copies = thin.withColumn("_home", F.explode(F.filter(homes, lambda b: b.isNotNull())))
    copies = copies.drop("_block")
    key_fields = [copies.schema[k] for k in keys]

    def ends(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int, int]:
        frame = frame.sort_values(seq, kind="stable").reset_index(drop=True)
        low = int(frame["_home"].iloc[0]) * block_rows
        first = int((frame[seq] < low).sum())
        own = int(((frame[seq] >= low) & (frame[seq] < low + block_rows)).sum())
        columns = {c: frame[c].tolist() for c in [seq, *payload]}
        nxt = np.array([run_end(columns, first + i) - first for i in range(own)], dtype=np.int64)
        return frame, nxt, first, own

    def leave(bucket: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, block in bucket.groupby([*keys, "_home"], sort=False):
            _, nxt, _, own = ends(block)
            left = np.empty(own, dtype=np.int64)
            for i in range(own - 1, -1, -1):
                left[i] = nxt[i] - own if nxt[i] >= own else left[nxt[i]]
            out.append((*key, left[: lookahead + 1].tolist(), own))
        return pd.DataFrame(out, columns=[*keys, "_home", "_leave", "_own"])

    leave_schema = T.StructType(
        [
            *key_fields,
            T.StructField("_home", T.LongType()),
            T.StructField("_leave", T.ArrayType(T.LongType())),
            T.StructField("_own", T.LongType()),
        ]
    )
    copies = written(copies, f"{name}-items")
    # A block that owns no row of its own exists only as a neighbour of the last one.
    owned = copies.where(F.floor(F.col(seq) / block_rows) == F.col("_home")).select(
        *keys, "_home"
    ).distinct()
    copies = copies.join(owned, [*keys, "_home"], "left_semi")
    # Blocks are dealt to buckets of a few blocks' rows each: small groups share a Python call,
    # and none grows with the data.
    buckets = max(1, copies.count() // (4 * block_rows))
    bucket = F.pmod(F.xxhash64(*keys, "_home"), F.lit(buckets)).alias("_bucket")
    tables = copies.groupBy(bucket).applyInPandas(leave, leave_schema)

    single = F.max("_home").over(Window.partitionBy(*keys)) == 0
    tables = written(tables.withColumn("_one", single), f"{name}-tables")

    def enter(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_home", kind="stable")
        entry, out = 0, []
        for table, own in zip(frame["_leave"], frame["_own"], strict=True):
            out.append(entry)
            entry = int(table[entry]) if entry < own else entry - int(own)
        return frame.assign(_entry=out)[[*keys, "_home", "_entry"]]

    entry_schema = T.StructType(
        [
            *key_fields,
            T.StructField("_home", T.LongType()),
            T.StructField("_entry", T.LongType()),
        ]
    )
    # Most keys fit one block and need no chain at all.
    entries = tables.where("_one").select(*keys, "_home", F.lit(0).cast("bigint").alias("_entry"))
    entries = entries.unionByName(
        tables.where("not _one").groupBy(*keys).applyInPandas(enter, entry_schema)
    )
    def mark(bucket: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in bucket.groupby([*keys, "_home"], sort=False):
            frame, nxt, first, own = ends(block)
            flags = np.zeros(own, dtype=np.int32)
            at = int(frame["_entry"].iloc[0])
            while at < own:
                flags[at] = 1
                at = int(nxt[at])
            out.append(frame.iloc[first : first + own][[*keys, seq]].assign(run_start=flags))
        return pd.concat(out)

    mark_schema = T.StructType(
        [*key_fields, copies.schema[seq], T.StructField("run_start", T.IntegerType())]
    )
    marked = (
        copies.join(entries, [*keys, "_home"])
        .groupBy(bucket)
        .applyInPandas(mark, mark_schema)
    )
    return items.join(marked, [*keys, seq])
