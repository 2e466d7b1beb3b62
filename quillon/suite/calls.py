"""Events as call streams and conversations as messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import calls as C
from quillon.operators import replies
from quillon.operators.stats import latency_summary
from quillon.suite.base import register, table


def transcript(spark: SparkSession, sf: str) -> DataFrame:
    """A user is a call; the event's type says what the recogniser reported."""
    e = table(spark, sf, "events")
    kinds = {"view": "interim", "click": "final", "purchase": "final", "signup": "utterance_end"}
    kind = F.lit("speech_started")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return e.select(
        F.col("user_id").alias("call_id"), "event_id",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts_us"),
        kind.alias("type"),
        F.concat("event_type", F.get_json_object("props", "$.k")).alias("text"),
        (F.col("event_type") == "purchase").alias("speech_final"),
        F.when(F.col("event_id") % 3 > 0, F.col("value") % 1.0).alias("confidence"),
        (F.col("value") * 10).alias("endpoint_latency_ms"),
        "value",
    )


EVENTS = """
ev AS (SELECT user_id AS call_id, event_id, epoch_us(ts) AS ts_us, event_type,
  CASE event_type WHEN 'view' THEN 'interim' WHEN 'click' THEN 'final' WHEN 'purchase' THEN 'final' WHEN 'signup' THEN 'utterance_end' ELSE 'speech_started' END AS type,
  event_type || json_extract_string(props, '$.k') AS text, event_type = 'purchase' AS speech_final,
  CASE WHEN event_id % 3 > 0 THEN value % 1.0 END AS confidence, value * 10 AS endpoint_latency_ms, value,
  event_type IN ('purchase', 'signup') AS ends FROM events)"""
ORDER = "PARTITION BY call_id ORDER BY ts_us, event_id"
UTTERANCES = f"""
turns AS (SELECT *, coalesce(sum(ends::INT) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS turn FROM ev),
utt AS (SELECT call_id, turn, string_agg(text, ' ' ORDER BY ts_us, event_id) FILTER (type = 'final') AS text,
    round(avg(confidence) FILTER (type = 'final'), 4) AS confidence,
    coalesce(max(CASE WHEN ends THEN CASE type WHEN 'final' THEN 'speech_final' ELSE 'utterance_end' END END), 'stream_closed') AS end_reason,
    max(CASE WHEN ends THEN endpoint_latency_ms END) AS endpoint_latency_ms FROM turns GROUP BY 1, 2
  HAVING count(*) FILTER (type = 'final') > 0)"""


@register(
    "call_utterances", "W12 R1",
    f"WITH {EVENTS},{UTTERANCES} SELECT call_id, turn, text, round(confidence, 6) AS confidence, end_reason, endpoint_latency_ms FROM utt",
)
def call_utterances(spark: SparkSession, sf: str) -> DataFrame:
    return C.utterances(transcript(spark, sf)).select(
        "call_id", "turn", "text", F.round("confidence", 6).alias("confidence"), "end_reason", "endpoint_latency_ms"
    )


LIVE = f"""
    said AS (SELECT *, coalesce(sum(ends::INT) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn,
        sum(ends::INT) OVER (PARTITION BY call_id) AS turns FROM ev WHERE type <> 'speech_started'),
    o AS (SELECT call_id, string_agg(text, ' ' ORDER BY ts_us, event_id) FILTER (type = 'final') AS finals,
      arg_max(CASE WHEN type = 'interim' THEN text ELSE '' END, (ts_us, event_id)) AS last FROM said WHERE turn = turns AND NOT ends GROUP BY 1),
    live AS (SELECT call_id, trim(coalesce(finals, '') || ' ' || coalesce(last, '')) AS transcript FROM (SELECT DISTINCT call_id FROM ev) LEFT JOIN o USING (call_id))"""


@register("live_transcripts", "R2", f"WITH {EVENTS},{LIVE} SELECT * FROM live")
def live_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return C.live_transcripts(transcript(spark, sf))


@register(
    "audio_sent_times", "J13",
    f"""WITH {EVENTS}, frames AS (SELECT call_id, event_id AS seq, value AS audio_end_s, ts_us AS sent_us FROM ev WHERE type IN ('interim', 'utterance_end')),
    p AS (SELECT call_id, event_id, value - 1e-6 AS x FROM ev WHERE type IN ('final', 'speech_started'))
    SELECT call_id, event_id, (SELECT arg_min(sent_us, (audio_end_s, seq)) FROM frames f WHERE f.call_id = p.call_id AND audio_end_s >= x) AS sent_us FROM p""",
)
def audio_sent_times(spark: SparkSession, sf: str) -> DataFrame:
    e = transcript(spark, sf)
    frames = e.where(F.col("type").isin("interim", "utterance_end")).select(
        "call_id", F.col("event_id").alias("seq"), F.col("value").alias("audio_end_s"), F.col("ts_us").alias("sent_us")
    )
    positions = e.where(F.col("type").isin("final", "speech_started")).select(
        "call_id", "event_id", F.col("value").alias("audio_s")
    )
    return C.sent_times(frames, positions)


LATENCY = ", ".join(
    ["count(value) AS n", "round(avg(value), 6) AS mean", "round(max(value), 6) AS max"]
    + [f"round(quantile_cont(value, {q}), 6) AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@register("latency_summary", "A1 R4", f"SELECT event_type AS metric, {LATENCY} FROM events GROUP BY 1")
def latency_by_metric(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "events").withColumnRenamed("event_type", "metric")
    return _rounded(latency_summary(samples, ["metric"], "value"), "mean", "max", "p50", "p95", "p99")


@register(
    "system_latency", "A8",
    "SELECT o_orderpriority AS system, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(max(o_totalprice), 6) AS max, "
    + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 6) AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    + " FROM orders GROUP BY 1",
)
def system_latency(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "system")
    return _rounded(latency_summary(samples, ["system"], "o_totalprice"), "mean", "max", "p50", "p95", "p99")


@register(
    "call_snapshots", "A24 A1",
    f"""WITH {EVENTS}, c AS (SELECT call_id, min(ts_us) AS started_us, max(ts_us) AS ended_us, count(*) FILTER (ends) AS turns,
      count(*) FILTER (type = 'interim') AS interims, arg_max(type, (ts_us, event_id)) AS last_type, round((max(ts_us) - min(ts_us)) / 1e6, 2) AS duration_s FROM ev GROUP BY 1)
    SELECT * FROM c JOIN (SELECT call_id, event_type AS metric, {LATENCY} FROM ev GROUP BY 1, 2) USING (call_id)""",
)
def call_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    e = transcript(spark, sf)
    samples = table(spark, sf, "events").select(
        F.col("user_id").alias("call_id"), F.col("event_type").alias("metric"), F.col("value").alias("value_ms")
    )
    return _rounded(C.call_snapshots(e, samples), "mean", "max", "p50", "p95", "p99")


@register(
    "recent_calls", "T10 R14",
    f"WITH {EVENTS} SELECT call_id, max(ts_us) AS ended_us FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
)
def recent_calls(spark: SparkSession, sf: str) -> DataFrame:
    return C.recent_calls(transcript(spark, sf).groupBy("call_id").agg(F.max("ts_us").alias("ended_us")))


SESSIONS = f"""
gaps AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER ({ORDER}) >= 900000000, true) AS opens FROM ev),
marked AS (SELECT *, max(CASE WHEN opens THEN ts_us END) OVER ({ORDER}) AS started_us FROM gaps)"""


@register(
    "idle_sessions", "R7",
    f"WITH {EVENTS},{SESSIONS} SELECT call_id, started_us, max(ts_us) AS ended_us, count(*) AS events FROM marked GROUP BY 1, 2",
)
def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return C.idle_sessions(transcript(spark, sf))


def play_us():
    return F.round(F.col("value") * 300 * 1e6).cast("bigint")


def audio_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Views as chunks of audio that play for a while after they are sent."""
    return transcript(spark, sf).where("type = 'interim'").select(
        "call_id", "event_id", "ts_us", play_us().alias("play_us")
    )


PLAYBACK = f"""
audio AS (SELECT call_id, event_id, ts_us, round(value * 300 * 1e6)::BIGINT AS play_us FROM ev WHERE type = 'interim'),
summed AS (SELECT *, coalesce(sum(play_us) OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM audio),
playback AS (SELECT call_id, event_id, ts_us, play_us, (max(ts_us - before) OVER ({ORDER}) + before + play_us)::BIGINT AS until_us FROM summed)"""


@register("playback_horizon", "R6", f"WITH {EVENTS},{PLAYBACK} SELECT * FROM playback")
def playback_horizon(spark: SparkSession, sf: str) -> DataFrame:
    return C.playback_until(audio_chunks(spark, sf))


RECOVERIES = """
    s AS (SELECT call_id, event_id, ts_us,
        (SELECT arg_max(until_us, (p.ts_us, p.event_id)) FROM playback p WHERE p.call_id = e.call_id AND (p.ts_us, p.event_id) < (e.ts_us, e.event_id)) AS playing,
        (SELECT min(f.ts_us) FROM ev f WHERE f.call_id = e.call_id AND f.type = 'final' AND (f.ts_us, f.event_id) > (e.ts_us, e.event_id)) AS next_us
      FROM ev e WHERE type = 'speech_started')
    SELECT call_id, event_id, ts_us + 3600000000 AS recover_us FROM s WHERE ts_us < playing AND (next_us IS NULL OR next_us - ts_us > 3600000000)"""


@register("barge_in_recoveries", "R5", f"WITH {EVENTS},{PLAYBACK},{RECOVERIES}")
def barge_in_recoveries(spark: SparkSession, sf: str) -> DataFrame:
    e = transcript(spark, sf)
    pick = ("call_id", "event_id", "ts_us")
    return C.barge_in_recoveries(
        e.where("type = 'speech_started'").select(*pick),
        C.playback_until(audio_chunks(spark, sf)),
        e.where("type = 'final'").select(*pick),
        wait_seconds=3600,
    )


@register(
    "reply_latencies", "W14",
    f"""WITH {EVENTS}, m AS (SELECT *, ends AS is_end FROM ev WHERE ends OR type = 'interim'),
    w AS (SELECT *, max(CASE WHEN is_end THEN ts_us END) OVER p AS end_us, max(CASE WHEN NOT is_end THEN ts_us END) OVER p AS audio_us,
      last_value(CASE WHEN is_end THEN endpoint_latency_ms END IGNORE NULLS) OVER p AS endpoint FROM m
      WINDOW p AS ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT call_id, event_id, round((ts_us - end_us) / 1000, 6) AS response_ms, round(endpoint + (ts_us - end_us) / 1000, 6) AS voice_to_voice_ms
    FROM w WHERE NOT is_end AND end_us IS NOT NULL AND (audio_us IS NULL OR end_us >= audio_us)""",
)
def reply_latencies(spark: SparkSession, sf: str) -> DataFrame:
    e = transcript(spark, sf)
    mark = F.when(C.is_end(), "end").when(F.col("type") == "interim", "audio")
    found = C.reply_latencies(
        e.select("call_id", "event_id", "ts_us", mark.alias("mark"), F.col("endpoint_latency_ms").alias("endpoint_ms"))
    )
    return _rounded(found, "response_ms", "voice_to_voice_ms")


@register(
    "alternating_turns", "W13",
    r"""WITH s AS (SELECT * FROM conversations WHERE role <> 'system' AND trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> '')
    SELECT conv_id, turn, role, text FROM s WHERE turn >= (SELECT min(turn) FROM s u WHERE u.conv_id = s.conv_id AND role = 'user')""",
)
def alternating_turns(spark: SparkSession, sf: str) -> DataFrame:
    return C.alternating_turns(table(spark, sf, "conversations"))


@register(
    "coalesced_replies", "R13",
    """WITH c AS (SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS reply_no FROM conversations)
    SELECT conv_id, reply_no, min(turn) FILTER (role = 'assistant') AS reply_turn, count(*) FILTER (role = 'user') AS user_turns,
      min(turn) FILTER (role = 'user') AS first_user_turn FROM c GROUP BY 1, 2 HAVING count(*) FILTER (role = 'user') > 0""",
)
def coalesced_replies(spark: SparkSession, sf: str) -> DataFrame:
    return C.coalesced_replies(table(spark, sf, "conversations"))


# A walk along each call that carries the state, where the reply began, and what it answers.
SPOKEN = f"""
marks AS (SELECT call_id, event_id, ts_us, CASE WHEN ends THEN 'said' WHEN type = 'interim' THEN 'audio' WHEN type = 'final' THEN 'done' ELSE 'cut' END AS mark,
    row_number() OVER ({ORDER}) AS i FROM ev),
spoken AS (WITH RECURSIVE walk AS (
  SELECT call_id, 0::BIGINT AS i, false AS active, false AS heard, 0::BIGINT AS due, 0::BIGINT AS covers, NULL::BIGINT AS begun_id, NULL::BIGINT AS begun_us,
    NULL::BIGINT AS told_id, NULL::BIGINT AS told_us, NULL::BIGINT AS told_covers, false AS cut FROM (SELECT DISTINCT call_id FROM marks)
  UNION ALL SELECT call_id, i, CASE WHEN ends THEN due > 0 ELSE active OR mark = 'said' END,
    CASE WHEN ends THEN false ELSE heard OR (active AND mark = 'audio') END,
    CASE WHEN ends THEN 0 WHEN active AND mark = 'said' THEN due + 1 ELSE due END,
    CASE WHEN ends THEN due WHEN NOT active AND mark = 'said' THEN 1 ELSE covers END,
    CASE WHEN (ends AND due > 0) OR (NOT active AND mark = 'said') THEN event_id ELSE begun_id END,
    CASE WHEN (ends AND due > 0) OR (NOT active AND mark = 'said') THEN ts_us ELSE begun_us END,
    CASE WHEN ends AND heard THEN begun_id END, begun_us, covers, mark = 'cut'
  FROM (SELECT w.*  EXCLUDE (i), m.i, m.mark, m.event_id, m.ts_us, w.active AND (m.mark = 'done' OR (m.mark = 'cut' AND w.heard)) AS ends
    FROM walk w JOIN marks m ON m.call_id = w.call_id AND m.i = w.i + 1))
  SELECT call_id, told_us AS ts_us, told_id AS event_id, 'assistant' AS role, told_covers AS covers, cut AS interrupted FROM walk WHERE told_id IS NOT NULL
  UNION ALL SELECT call_id, ts_us, event_id, 'user', NULL, false FROM marks WHERE mark = 'said')"""


@register("spoken_history", "R13", f"WITH {EVENTS},{SPOKEN} SELECT * FROM spoken")
def spoken_history(spark: SparkSession, sf: str) -> DataFrame:
    """Turn ends are utterances, views audio; a segment ends a reply, other speech cuts it off."""
    kind = F.col("type")
    mark = F.when(C.is_end(), "said").when(kind == "interim", "audio").when(kind == "final", "done").otherwise("cut")
    marks = transcript(spark, sf).select("call_id", "event_id", "ts_us", mark.alias("mark"))
    return replies.spoken_history(marks, width=C.HOUR_US * 240)


@register(
    "single_use_tokens", "R9",
    f"""WITH {EVENTS} SELECT text AS token, min(ts_us) AS ts_us, arg_min(event_id, (ts_us, event_id)) AS event_id FROM ev GROUP BY 1""",
)
def single_use_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return C.single_use(transcript(spark, sf).withColumnRenamed("text", "token"))


@register(
    "transcript_events", "S18",
    f"WITH {EVENTS} SELECT call_id, event_id, ts_us, type, text, speech_final, round(confidence, 6) AS confidence FROM ev",
)
def transcript_events(spark: SparkSession, sf: str) -> DataFrame:
    return transcript(spark, sf).select(
        "call_id", "event_id", "ts_us", "type", "text", "speech_final", F.round("confidence", 6).alias("confidence")
    )
