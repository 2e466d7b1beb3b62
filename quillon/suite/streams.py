"""Streams over the events table, run to the end of what there is."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillon.functions.text import sentences, split_units
from quillon.operators import bm25
from quillon.operators.compress import compress
from quillon.session import shared_dir, written
from quillon.streaming import calls as S
from quillon.streaming.ledger import claim_batch, current_version, upsert_batch
from quillon.suite.base import register, table
from quillon.suite.calls import EVENTS, LATENCY, LIVE, PLAYBACK, RECOVERIES, SESSIONS, UTTERANCES, play_us, transcript
from quillon.suite.retrieval import chunks, questions

CLOSING = "timestamp'2100-01-01'"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Feed:
    """A folder that is filled slice by slice, and the stream over it."""

    folder: str
    slices: tuple[DataFrame, ...]

    @property
    def stream(self) -> DataFrame:
        first = self.slices[0]
        return first.sparkSession.readStream.schema(first.schema).parquet(f"{self.folder}/*")

    def run(self, write: Callable[[], DataStreamWriter]) -> None:
        """After each slice the query takes up where it left and runs to the end of what there is."""
        for number, rows in enumerate(self.slices):
            rows.write.parquet(f"{self.folder}/{number}")
            write().trigger(availableNow=True).start().awaitTermination()


def event_feed(spark: SparkSession, sf: str, columns: list[str], closed: bool = True) -> Feed:
    """The events in three slices of time; ``closed`` adds rows far in the future of a call of its
    own, which let all that waits go."""
    rows = transcript(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    cuts = rows.select(F.percentile_approx("ts_us", [0.4, 0.8]).alias("at")).first()["at"] or [0, 0]
    at = F.col("ts_us")
    parts = [rows.where(at <= cuts[0]), rows.where((at > cuts[0]) & (at <= cuts[1])), rows.where(at > cuts[1])]
    parts = [p.select(*columns) for p in parts]
    if closed:
        last = rows.limit(1).withColumn("call_id", F.lit(-1).cast("long")).withColumn("ts", F.expr(CLOSING)).select(*columns)
        parts[-1] = parts[-1].unionByName(last)
        parts.append(last.withColumn("ts", F.expr(f"{CLOSING} + interval 1 day")))
    return Feed(_folder(spark, "stream"), tuple(parts))


def finished(df: DataFrame, name: str, feed: Feed) -> DataFrame:
    """The stream's whole output as a table."""
    spark = df.sparkSession
    out, state = _folder(spark, name), _folder(spark, f"{name}-state")
    feed.run(lambda: df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    return spark.read.schema(df.schema).parquet(out)


@register(
    "utterance_stream", "R1",
    f"WITH {EVENTS},{UTTERANCES} SELECT call_id, text, round(confidence, 6) AS confidence, end_reason, endpoint_latency_ms FROM utt",
)
def utterance_stream(spark: SparkSession, sf: str) -> DataFrame:
    feed = event_feed(
        spark, sf, ["call_id", "event_id", "ts", "type", "text", "speech_final", "confidence", "endpoint_latency_ms"]
    )
    out = finished(S.utterance_stream(feed.stream, idle_seconds=60 * 86400), "utterances", feed)
    return out.where("call_id >= 0").withColumn("confidence", F.round("confidence", 6))


@register(
    "idle_session_stream", "R7",
    f"WITH {EVENTS},{SESSIONS} SELECT call_id, started_us, count(*) AS events FROM marked GROUP BY 1, 2",
)
def idle_session_stream(spark: SparkSession, sf: str) -> DataFrame:
    feed = event_feed(spark, sf, ["call_id", "event_id", "ts"])
    out = finished(S.idle_sessions(feed.stream), "sessions", feed)
    return out.where("call_id >= 0")


@register(
    "latency_window_stream", "R4",
    f"""WITH {EVENTS} SELECT ts_us - ts_us % 86400000000 AS start_us, call_id, event_type AS metric, {LATENCY} FROM ev GROUP BY 1, 2, 3""",
)
def latency_window_stream(spark: SparkSession, sf: str) -> DataFrame:
    feed = event_feed(spark, sf, ["call_id", "event_id", "ts", "text", "value"])
    samples = feed.stream.select("call_id", "ts", F.regexp_replace("text", r"\d+$", "").alias("metric"), F.col("value").alias("value_ms"))
    out = finished(S.latency_windows(samples, "1 day"), "windows", feed).where("call_id >= 0")
    for c in ("mean", "max", "p50", "p95", "p99"):
        out = out.withColumn(c, F.round(c, 6))
    return out


HITS = """hits AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM ({SOURCE})),
walk AS (
  SELECT key, event_id, i, true AS allowed, [ts] AS held FROM hits WHERE i = 1
  UNION ALL SELECT key, event_id, i, len(held) < {MOST}, CASE WHEN len(held) < {MOST} THEN list_append(held, ts) ELSE held END
  FROM (SELECT h.key, h.event_id, h.i, h.ts, list_filter(w.held, lambda x: epoch_us(h.ts) - epoch_us(x) <= {SECONDS}000000) AS held
    FROM walk w JOIN hits h ON h.key = w.key AND h.i = w.i + 1))"""


def limited_sql(source: str, most: int, seconds: int) -> str:
    """A walk along each key's hits that carries the accepted ones."""
    walk = HITS.replace("{SOURCE}", source).replace("{MOST}", str(most)).replace("{SECONDS}", str(seconds))
    return f"WITH RECURSIVE {walk} SELECT key, event_id, allowed FROM walk"


TOKENS = "SELECT event_type || json_extract_string(props, '$.k') AS key, event_id, ts FROM events"


@register("single_use_stream", "R9", limited_sql(TOKENS, 1, 5 * 86400))
def single_use_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A token lives for five days; the events last longer, so tokens are claimed again."""
    feed = event_feed(spark, sf, ["call_id", "event_id", "ts", "text"], closed=False)
    return finished(S.single_use(feed.stream.withColumnRenamed("text", "token"), 5 * 86400.0), "tokens", feed)


@register("rate_limit_stream", "R8", limited_sql("SELECT user_id AS key, event_id, ts FROM events", 3, 86400))
def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    feed = event_feed(spark, sf, ["call_id", "event_id", "ts"], closed=False)
    hits = feed.stream.withColumnRenamed("call_id", "key")
    return finished(S.rate_limit_stream(hits, most=3, seconds=86400.0), "verdicts", feed)


# Whole replies are read from the left: each step takes the text to the next closing mark.
SENTENCE_WALK = r"""WITH RECURSIVE replies AS (SELECT conv_id * 1000 + turn AS reply_id, text FROM conversations WHERE role = 'assistant'),
walk AS (
  SELECT reply_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS sentence, '' AS pending, text AS rest FROM replies
  UNION ALL SELECT reply_id, i + 1, CASE WHEN closed THEN candidate END, CASE WHEN closed THEN '' ELSE pending || taken END, substring(rest, length(taken) + 1)
  FROM (SELECT *, length(candidate) >= 12 AND NOT regexp_matches(candidate, '(?i)(?:^|\s)[("'']*(?:dr|mr|mrs|ms|prof|st|vs|etc|e\.g|i\.e|approx)\.$') AS closed
    FROM (SELECT *, trim(pending || regexp_extract(rest, '(?s)^(.*?[.!?]+["'')\]]*)\s+', 1)) AS candidate, regexp_extract(rest, '(?s)^(.*?[.!?]+["'')\]]*)\s+') AS taken
      FROM walk) WHERE taken <> '')),
ends AS (SELECT reply_id, trim(arg_max(pending || rest, i)) AS sentence FROM walk GROUP BY 1)
SELECT reply_id, sentence FROM walk WHERE sentence IS NOT NULL UNION ALL SELECT reply_id, sentence FROM ends WHERE sentence <> ''"""


@register("sentence_stream", "R3", SENTENCE_WALK)
def sentence_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Replies arrive in two pieces each."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id")
    half = F.floor(F.length("text") / 2).cast("int")
    first = c.select(key, F.lit(0).alias("seq"), F.substr("text", F.lit(1), half).alias("text"), F.lit(False).alias("last"))
    second = c.select(key, F.lit(1).alias("seq"), F.substr("text", half + 1).alias("text"), F.lit(True).alias("last"))
    feed = Feed(_folder(spark, "replies"), (first, second))
    return finished(S.sentence_stream(feed.stream), "sentences", feed)


@register(
    "send_once_ledger", "R10 J14",
    "SELECT 'low:' || user_id || ':' || CAST(ts AS DATE) AS dedupe_key, user_id AS client_id FROM events GROUP BY 1, 2",
)
def send_once_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every event asks for its user's message of the day; the ledger lets one through."""
    feed = event_feed(spark, sf, ["call_id", "event_id", "ts"], closed=False)
    asks = feed.stream.select(
        F.concat_ws(":", F.lit("low"), "call_id", F.to_date("ts")).alias("dedupe_key"),
        F.col("call_id").alias("client_id"), F.lit("send").alias("decision"),
    )
    ledger, state = _folder(spark, "ledger"), _folder(spark, "ledger-state")
    feed.run(lambda: asks.writeStream.foreachBatch(claim_batch(ledger, "events")).option("checkpointLocation", state))
    return spark.read.parquet(ledger).select("dedupe_key", "client_id")


@register("barge_in_stream", "R5", f"WITH {EVENTS},{PLAYBACK},{RECOVERIES}")
def barge_in_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's twin of ``barge_in_recoveries``: words that do not come are noticed by a timer."""
    feed = event_feed(spark, sf, ["call_id", "event_id", "ts", "type", "value"])
    kind = F.when(F.col("type") == "speech_started", "start").when(F.col("type") == "final", "words").when(F.col("type") == "interim", "audio")
    marks = feed.stream.select("call_id", "event_id", "ts", kind.alias("kind"), play_us().alias("play_us")).where("kind is not null or call_id < 0")
    return finished(S.barge_in_stream(marks, wait_seconds=3600), "recoveries", feed)


IDLE_DAYS = 3


@register(
    "live_call_stream", "R2 R14",
    f"""WITH {EVENTS},{LIVE}, ends AS (SELECT call_id, max(ts_us) AS ended_us FROM ev GROUP BY 1)
    SELECT call_id, transcript, ended_us, ended_us // 1000 + {IDLE_DAYS * 86_400_000} > (SELECT max(ts_us) // 1000 - 600000 FROM ev) AS active
    FROM live JOIN ends USING (call_id)""",
)
def live_call_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The live set after the last event: what each call shows, and whether it still runs."""
    feed = event_feed(spark, sf, ["call_id", "event_id", "ts", "type", "text", "speech_final"], closed=False)
    changes = S.live_call_stream(feed.stream, idle_seconds=IDLE_DAYS * 86400)
    path, state = _folder(spark, "live"), _folder(spark, "live-state")
    keep = upsert_batch(path, ["call_id"], "ended_us")
    feed.run(lambda: changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state))
    return current_version(spark, path)


@register("compressed_passages", "B5 H6")
def compressed_passages(spark: SparkSession, sf: str) -> DataFrame:
    """The five best passages of every benchmark question, compressed for it."""
    c = written(chunks(spark, sf), "chunks")
    asked = questions(spark, sf).select("query_id", "text")
    hits = bm25.search(bm25.build_index(c), asked, 5).select("query_id", "chunk_id")
    texts = hits.join(c.select("chunk_id", "text"), "chunk_id").join(
        asked.withColumnRenamed("text", "query_text"), "query_id"
    )
    return compress(texts, 60).select("query_id", "chunk_id", "original_tokens", "kept_tokens", "kept_units", "total_units")


def split_sql(text: str) -> str:
    """Sentences: cut behind closing punctuation and space where a capital, digit or mark follows."""
    mark = "chr(1)"
    cut = rf"""regexp_replace({text}, '([.!?;])\s+([A-Z0-9("''•-])', '\1' || {mark} || '\2', 'g')"""
    return f"string_split({cut}, {mark})"


TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@register(
    "text_units", "H5 H6 F1",
    f"""SELECT doc_id, len(list_filter({split_sql('text')}, lambda s: trim(s) <> '')) AS sentences,
      coalesce(list_sum(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: {TRIMMED.format('l')}), lambda l: l <> ''),
        lambda l: CASE WHEN l[1] IN ('-', '|') THEN 1 ELSE len(list_filter({split_sql('l')}, lambda s: {TRIMMED.format('s')} <> '')) END)), 0)::BIGINT AS units
    FROM documents""",
)
def text_units(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.size(sentences(t)).alias("sentences"), F.size(split_units(t)).alias("units")
    )
