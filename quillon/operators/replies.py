"""Replies spoken one at a time: what was heard of each, where it belongs, what it answers.

A call is in one of five states: nobody replies; a reply is being written or can be heard, each
with or without something said since it began. Every event maps states to states, and maps in a
row are one map, so blocks of a call are worked out alone, for each state they may be entered in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.calls import HOUR_US, time_block
from quillon.scale import block_scan, join_small
from quillon.session import written

IDLE, WRITING, WRITING_DUE, HEARD, HEARD_DUE = range(5)
# Where each mark leads from each state. A new reply begins where something is due at an end; an
# interruption leaves a reply that can't be heard yet alone.
LEADS = {
    "said": (WRITING, WRITING_DUE, WRITING_DUE, HEARD_DUE, HEARD_DUE),
    "audio": (IDLE, HEARD, HEARD_DUE, HEARD, HEARD_DUE),
    "done": (IDLE, IDLE, WRITING, IDLE, WRITING),
    "cut": (IDLE, WRITING, WRITING_DUE, IDLE, WRITING),
}


def with_states(events: DataFrame, width: int = HOUR_US) -> DataFrame:
    """``events(call_id, event_id, ts_us, mark)`` with ``state``, that before each event."""
    rows = written(
        events.where(F.col("mark").isin(*LEADS))
        .select("call_id", "event_id", "ts_us", "mark")
        .withColumn("block", time_block(width=width)),
        "marks",
    )
    call = rows.schema["call_id"]
    inside = T.StructType(
        [call, T.StructField("block", T.LongType()), rows.schema["event_id"],
         T.StructField("before", T.ArrayType(T.IntegerType())), T.StructField("after", T.ArrayType(T.IntegerType()))]
    )

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts_us", "event_id"], kind="stable")
        leads = {mark: np.array(to) for mark, to in LEADS.items()}
        at, before = np.arange(5), []
        for mark in frame["mark"]:
            before.append(at.tolist())
            at = leads[mark][at]
        after = [None] * (len(frame) - 1) + [at.tolist()]
        return pd.DataFrame(
            {"call_id": frame["call_id"], "block": frame["block"], "event_id": frame["event_id"], "before": before, "after": after}
        )

    walked = written(rows.groupBy("call_id", "block").applyInPandas(walk, inside), "walked")
    # One small row for each block of a call: its map, in order of time.
    blocks = walked.where("after is not null").groupBy("call_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "after"))).alias("blocks")
    )
    entered = F.aggregate(
        "blocks",
        F.struct(F.lit(IDLE).alias("state"), F.array().cast("array<struct<block:bigint,entry:int>>").alias("entries")),
        lambda held, b: F.struct(
            F.get(b["after"], held["state"]).alias("state"),
            F.concat(held["entries"], F.array(F.struct(b["block"].alias("block"), held["state"].alias("entry")))).alias("entries"),
        ),
    )
    entries = blocks.select("call_id", F.inline(entered["entries"]))
    states = join_small(walked.drop("after"), entries, ["call_id", "block"], ["event_id"])
    states = states.select("call_id", "event_id", F.get("before", F.col("entry")).alias("state"))
    return rows.drop("block").join(states, ["call_id", "event_id"])


def spoken_history(events: DataFrame, width: int = HOUR_US) -> DataFrame:
    """``(call_id, ts_us, event_id, role, covers, interrupted)``: utterances, and the replies of
    which something could be heard.

    A reply stands right behind the event at which it began, ``event_id``, whatever was said while
    it was spoken; ``covers`` counts the utterances it answers. A reply without an end isn't told.
    Marks: ``said``, ``audio``, ``done`` and ``cut``; other rows don't take part.
    """
    rows = with_states(events, width)
    mark, state = F.col("mark"), F.col("state")
    due = state.isin(WRITING_DUE, HEARD_DUE)
    ends = ((mark == "done") & (state != IDLE)) | ((mark == "cut") & state.isin(HEARD, HEARD_DUE))
    begins = ((mark == "said") & (state == IDLE)) | (ends & due)
    rows = written(rows.withColumn("ends", ends).withColumn("begins", begins), "reply-marks")
    numbered = block_scan(
        rows, ["call_id"], time_block(width=width), ["ts_us", "event_id"],
        reply=("sum_before", F.col("begins").cast("bigint")),
    )
    # The reply under way before an event has the number of replies begun before it.
    parts = F.array(
        F.when(F.col("ends"), F.struct(F.col("reply").alias("no"), F.lit("end").alias("part"))),
        F.when(F.col("begins"), F.struct((F.col("reply") + 1).alias("no"), F.lit("begin").alias("part"))),
        F.when(mark == "said", F.struct((F.col("reply") + 1).alias("no"), F.lit("said").alias("part"))),
    )
    told = numbered.select(
        "call_id", "ts_us", "event_id", "mark", "state",
        F.inline(F.filter(parts, lambda p: p.isNotNull())),
    )
    at = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    replies = told.groupBy("call_id", "no").agg(
        at("begin", "ts_us").alias("ts_us"), at("begin", "event_id").alias("event_id"),
        at("end", "mark").alias("end"), at("end", "state").alias("end_state"),
        F.count(F.when(F.col("part") == "said", 1)).alias("covers"),
    ).where(F.col("event_id").isNotNull() & F.col("end_state").isin(HEARD, HEARD_DUE))
    said = rows.where("mark = 'said'").select(
        "call_id", "ts_us", "event_id", F.lit("user").alias("role"),
        F.lit(None).cast("bigint").alias("covers"), F.lit(False).alias("interrupted"),
    )
    return said.unionByName(
        replies.select(
            "call_id", "ts_us", "event_id", F.lit("assistant").alias("role"), "covers",
            (F.col("end") == "cut").alias("interrupted"),
        )
    )
