"""Calls and conversations from event rows: utterances, latencies, sessions, replies.

Every running value along a call is a ``block_scan`` over time blocks, so one very long or very
busy call is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import squeeze
from quillon.operators.stats import latency_summary
from quillon.scale import block_scan

IDLE_SECONDS = 900
BARGE_IN_SECONDS = 6
RECENT_CALLS = 50
HOUR_US = 3_600_000_000
# A position may lie this far behind the end of its own frame.
AUDIO_TOLERANCE = 1e-6
# Fixed value: an utterance's confidence is the mean of its segments to so many digits.
CONFIDENCE_DIGITS = 4


def time_block(ts: str = "ts_us", width: int = HOUR_US) -> Column:
    return F.floor(F.col(ts) / width)


def is_end() -> Column:
    """Events that complete a turn."""
    return ((F.col("type") == "final") & F.coalesce("speech_final", F.lit(False))) | (
        F.col("type") == "utterance_end"
    )


def _is_segment() -> Column:
    return (F.col("type") == "final") & (F.coalesce("text", F.lit("")) != "")


def utterances(events: DataFrame, width: int = HOUR_US) -> DataFrame:
    """``events(call_id, event_id, ts_us, type, text, speech_final, confidence,
    endpoint_latency_ms)`` to one row for each utterance.

    Final segments gather until an end event; an end without segments says nothing; what is
    left when the stream closes is an utterance of its own.
    """
    placed = block_scan(
        events, ["call_id"], time_block(width=width), ["ts_us", "event_id"],
        turn=("sum_before", is_end().cast("bigint")),
    )
    segment = F.when(_is_segment(), F.struct("ts_us", "event_id", "text"))
    grouped = placed.where(_is_segment() | is_end()).groupBy("call_id", "turn").agg(
        F.collect_list(segment).alias("_s"),
        F.round(F.avg(F.when(_is_segment(), F.col("confidence"))), CONFIDENCE_DIGITS).alias("confidence"),
        F.max(
            F.when(
                is_end(),
                F.struct(
                    F.when(F.col("type") == "final", "speech_final").otherwise("utterance_end").alias("reason"),
                    F.col("endpoint_latency_ms"),
                ),
            )
        ).alias("_end"),
        F.max("ts_us").alias("ended_us"),
    )
    return grouped.where(F.size("_s") > 0).select(
        "call_id", "turn",
        F.array_join(F.transform(F.array_sort("_s"), lambda s: s["text"]), " ").alias("text"),
        "confidence",
        F.coalesce("_end.reason", F.lit("stream_closed")).alias("end_reason"),
        F.col("_end.endpoint_latency_ms").alias("endpoint_latency_ms"),
        "ended_us",
    )


def live_transcripts(events: DataFrame, width: int = HOUR_US) -> DataFrame:
    """(call_id, transcript): what each call shows right now: segments not yet an utterance,
    and the newest partial words after them."""
    placed = block_scan(
        events.where(F.col("type").isin("final", "interim", "utterance_end")),
        ["call_id"], time_block(width=width), ["ts_us", "event_id"],
        turn=("sum_before", is_end().cast("bigint")), turns=("total", is_end().cast("bigint")),
    )
    open_ = placed.where((F.col("turn") == F.col("turns")) & ~is_end())
    at = F.struct("ts_us", "event_id")
    grouped = open_.groupBy("call_id").agg(
        F.collect_list(F.when(_is_segment(), F.struct("ts_us", "event_id", "text"))).alias("_s"),
        F.max_by(F.when(F.col("type") == "interim", F.col("text")), at).alias("_interim"),
    )
    finals = F.transform(F.array_sort("_s"), lambda s: s["text"])
    return events.select("call_id").distinct().join(grouped, "call_id", "left").select(
        "call_id", F.coalesce(F.concat_ws(" ", finals, "_interim"), F.lit("")).alias("transcript")
    )


def sent_times(frames: DataFrame, positions: DataFrame, width: float = 60.0) -> DataFrame:
    """As-of join: when the frame holding an audio position was sent; null if none reaches it.

    ``frames(call_id, seq, audio_end_s, sent_us)``, ``positions(call_id, event_id, audio_s)``.
    Both lie on one backwards axis and the nearest frame behind is filled forward along it.
    """
    f = frames.select(
        "call_id", (-F.col("audio_end_s")).alias("_x"), F.lit(0).alias("_kind"),
        (-F.col("seq")).alias("_seq"), "sent_us", F.lit(None).cast("bigint").alias("event_id"),
    )
    p = positions.select(
        "call_id", (AUDIO_TOLERANCE - F.col("audio_s")).alias("_x"), F.lit(1).alias("_kind"),
        F.col("event_id").alias("_seq"), F.lit(None).cast("bigint").alias("sent_us"), "event_id",
    )
    filled = block_scan(
        f.unionByName(p), ["call_id"], F.floor(F.col("_x") / width), ["_x", "_kind", "_seq"],
        found_us=("fill", "sent_us"),
    )
    return filled.where("_kind = 1").select("call_id", "event_id", F.col("found_us").alias("sent_us"))


def call_snapshots(events: DataFrame, samples: DataFrame) -> DataFrame:
    """One row for each call and metric: its state as far as the events go, and the latencies."""
    calls = events.groupBy("call_id").agg(
        F.min("ts_us").alias("started_us"),
        F.max("ts_us").alias("ended_us"),
        F.count(F.when(is_end(), 1)).alias("turns"),
        F.count(F.when(F.col("type") == "interim", 1)).alias("interims"),
        F.max_by("type", F.struct("ts_us", "event_id")).alias("last_type"),
    ).withColumn("duration_s", F.round((F.col("ended_us") - F.col("started_us")) / 1e6, 2))
    return calls.join(latency_summary(samples, ["call_id", "metric"], "value_ms"), "call_id", "left")


def recent_calls(calls: DataFrame, keep: int = RECENT_CALLS) -> DataFrame:
    """The calls that ended last."""
    return calls.orderBy(F.col("ended_us").desc(), "call_id").limit(keep)


def idle_sessions(events: DataFrame, gap_seconds: int = IDLE_SECONDS, width: int = HOUR_US * 24) -> DataFrame:
    """Stretches of activity no gap of which reaches ``gap_seconds``: one row for each session."""
    lagged = block_scan(
        events, ["call_id"], time_block(width=width), ["ts_us", "event_id"],
        before_us=("before", "ts_us"),
    )
    opens = F.col("before_us").isNull() | (
        F.col("ts_us") - F.col("before_us") >= gap_seconds * 1_000_000
    )
    starts = lagged.withColumn("start_us", F.when(opens, F.col("ts_us")))
    placed = block_scan(
        starts, ["call_id"], time_block(width=width), ["ts_us", "event_id"],
        session_us=("fill", "start_us"),
    )
    return placed.groupBy("call_id", F.col("session_us").alias("started_us")).agg(
        F.max("ts_us").alias("ended_us"), F.count(F.lit(1)).alias("events")
    )


def playback_until(chunks: DataFrame, width: int = HOUR_US) -> DataFrame:
    """``chunks(call_id, event_id, ts_us, play_us)`` with ``until_us``: when what was sent has
    played out.

    Each chunk plays after the one before it, or at once if that is over. In closed form: the
    playing time so far plus the latest of (arrival less the playing time before it).
    """
    order = ["ts_us", "event_id"]
    summed = block_scan(
        chunks, ["call_id"], time_block(width=width), order, _before=("sum_before", "play_us")
    )
    topped = block_scan(
        summed, ["call_id"], time_block(width=width), order,
        _slack=("max", F.col("ts_us") - F.col("_before")),
    )
    return topped.withColumn(
        "until_us", F.col("_slack") + F.col("_before") + F.col("play_us")
    ).drop("_slack", "_before")


def barge_in_recoveries(
    starts: DataFrame, playback: DataFrame, speech: DataFrame, wait_seconds: int = BARGE_IN_SECONDS,
    width: int = HOUR_US,
) -> DataFrame:
    """Speech starts that cut a reply off and were followed by no words in time.

    ``starts(call_id, event_id, ts_us)``, ``playback(call_id, event_id, ts_us, until_us)``,
    ``speech(call_id, event_id, ts_us)``; the question is asked again ``wait_seconds`` later.
    """
    null = F.lit(None).cast("bigint")
    marks = (
        starts.select("call_id", "event_id", "ts_us", null.alias("until_us"), null.alias("said_us"), F.lit(1).alias("_start"))
        .unionByName(playback.select("call_id", "event_id", "ts_us", "until_us", null.alias("said_us"), F.lit(0).alias("_start")))
        .unionByName(speech.select("call_id", "event_id", "ts_us", null.alias("until_us"), F.col("ts_us").alias("said_us"), F.lit(0).alias("_start")))
    )
    playing = block_scan(
        marks, ["call_id"], time_block(width=width), ["ts_us", "event_id"],
        playing_us=("before", "until_us"),
    ).withColumn("_back", -F.col("ts_us")).withColumn("_id", -F.col("event_id"))
    ahead = block_scan(
        playing, ["call_id"], F.floor(F.col("_back") / width), ["_back", "_id"],
        next_us=("before", "said_us"),
    )
    wait = wait_seconds * 1_000_000
    return ahead.where(
        (F.col("_start") == 1)
        & (F.col("ts_us") < F.col("playing_us"))
        & (F.col("next_us").isNull() | (F.col("next_us") - F.col("ts_us") > wait))
    ).select("call_id", "event_id", (F.col("ts_us") + wait).alias("recover_us"))


def reply_latencies(events: DataFrame, width: int = HOUR_US) -> DataFrame:
    """``events(call_id, event_id, ts_us, mark, endpoint_ms)`` with marks ``end`` and ``audio``:
    each first audio with the last turn that ended before it and was not yet answered."""
    end = F.col("mark") == "end"
    placed = block_scan(
        events.where(F.col("mark").isin("end", "audio")), ["call_id"], time_block(width=width),
        ["ts_us", "event_id"],
        last_end=("before", F.when(end, F.struct(F.col("ts_us").alias("at"), F.col("endpoint_ms")))),
        last_audio=("before", F.when(~end, F.col("ts_us"))),
    )
    answered = placed.where(
        (F.col("mark") == "audio")
        & (F.col("last_audio").isNull() | (F.col("last_end.at") >= F.col("last_audio")))
        & F.col("last_end").isNotNull()
    )
    response = (F.col("ts_us") - F.col("last_end.at")) / 1000
    return answered.select(
        "call_id", "event_id", response.alias("response_ms"),
        (F.col("last_end.endpoint_ms") + response).alias("voice_to_voice_ms"),
    )


def alternating_turns(messages: DataFrame, width: int = 1024) -> DataFrame:
    """``messages(conv_id, turn, role, text)`` without system and blank rows and without
    anything said before the first user turn."""
    said = messages.where((F.col("role") != "system") & (squeeze(F.coalesce("text", F.lit(""))) != ""))
    placed = block_scan(
        said, ["conv_id"], F.floor(F.col("turn") / width), ["turn"],
        _user=("max", (F.col("role") == "user").cast("int")),
    )
    return placed.where("_user = 1").drop("_user")


def coalesced_replies(messages: DataFrame, width: int = 1024) -> DataFrame:
    """Everything a user says up to the next reply is answered by that one reply."""
    placed = block_scan(
        messages, ["conv_id"], F.floor(F.col("turn") / width), ["turn"],
        reply_no=("sum_before", (F.col("role") == "assistant").cast("bigint")),
    )
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    return placed.groupBy("conv_id", "reply_no").agg(
        F.min(F.when(reply, F.col("turn"))).alias("reply_turn"),
        F.count(F.when(user, 1)).alias("user_turns"),
        F.min(F.when(user, F.col("turn"))).alias("first_user_turn"),
    ).where("user_turns > 0")


def single_use(claims: DataFrame) -> DataFrame:
    """The first claim of each token."""
    first = F.min(F.struct("ts_us", "event_id")).alias("_f")
    return claims.groupBy("token").agg(first).select("token", "_f.ts_us", "_f.event_id")


