"""Streams taken up again after each slice, against their batch twins."""

import tempfile

from pyspark.sql import functions as F

from quillon.operators import calls as C
from quillon.streaming import calls as S
from quillon.streaming.ledger import current_version, upsert_batch

EVENTS = "call_id long, event_id long, ts timestamp, type string, text string, speech_final boolean"


def test_live_calls_equal_the_batch_twin_after_every_slice(spark):
    kinds = [("interim", "he", False), ("final", "hello", False), ("interim", "wor", False), ("final", "world", True),
             ("final", None, False), ("interim", None, False), ("final", "again", False), ("utterance_end", None, False), ("interim", "x", False)]
    rows = [(call, 10 * call + i, f"2024-01-01 00:{i:02d}:{call:02d}", *kind) for call in range(3) for i, kind in enumerate(kinds[call:])]
    rows = spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    folder = tempfile.mkdtemp(prefix="quillon-live-")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
    changes = S.live_call_stream(stream, idle_seconds=86400)
    for part, (low, high) in enumerate(((0, 3), (3, 6), (6, 60))):
        rows.where(F.minute("ts").between(low, high - 1)).write.parquet(f"{folder}/in/{part}")
        query = changes.writeStream.outputMode("update").foreachBatch(upsert_batch(f"{folder}/live", ["call_id"], "ended_us"))
        query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        so_far = rows.where(F.minute("ts") < high).withColumn("ts_us", F.unix_micros("ts"))
        wanted = {tuple(r) for r in C.live_transcripts(so_far).collect()}
        live = current_version(spark, f"{folder}/live").where("active")
        assert {(r.call_id, r.transcript) for r in live.collect()} == wanted


def test_a_call_that_goes_on_after_it_was_finished_shows_its_open_words(spark):
    rows = [(1, 1, "2024-01-01 00:00:00", "final", "before", False), (1, 2, "2024-01-09 00:00:00", "interim", "after", False),
            (2, 3, "2024-01-01 00:00:00", "final", "done", True), (2, 4, "2024-01-09 00:00:00", "final", "anew", False),
            (3, 5, "2024-01-05 00:00:00", "interim", "gone", False)]
    rows = spark.createDataFrame(rows, EVENTS.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    folder = tempfile.mkdtemp(prefix="quillon-idle-")
    changes = S.live_call_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"), idle_seconds=86400)
    seen = []
    for day in (1, 5, 9):
        rows.where(F.dayofmonth("ts") == day).write.parquet(f"{folder}/in/{day}")
        query = changes.writeStream.outputMode("update").foreachBatch(upsert_batch(f"{folder}/live", ["call_id"], "ended_us"))
        query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        live = current_version(spark, f"{folder}/live")
        seen.append({(r.call_id, r.transcript, r.active) for r in live.collect()})
    assert seen[1] == {(1, "before", False), (2, "", False), (3, "gone", True)}
    assert seen[2] == {(1, "before after", True), (2, "anew", True), (3, "gone", False)}


def test_sentences_of_null_pieces_and_of_replies_that_stop(spark):
    rows = [(1, 0, "A first sentence here. And", False, "2024-01-01 00:00:00"), (1, 1, None, False, "2024-01-01 00:00:01"),
            (1, 2, " a rest", None, "2024-01-01 00:00:02"), (2, 0, None, True, "2024-01-01 00:00:00"),
            (3, 0, "Far later words", True, "2024-01-03 00:00:00")]
    pieces = spark.createDataFrame(rows, "reply_id long, seq int, text string, last boolean, ts string").withColumn("ts", F.to_timestamp("ts"))
    folder = tempfile.mkdtemp(prefix="quillon-said-")
    stream = spark.readStream.schema(pieces.schema).parquet(f"{folder}/in/*")
    said = S.sentence_stream(stream, idle_seconds=60)
    for part, some in enumerate((pieces.where("reply_id < 3"), pieces.where("reply_id = 3"))):
        some.write.parquet(f"{folder}/in/{part}")
        query = said.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        query.trigger(availableNow=True).start().awaitTermination()
    found = {tuple(r) for r in spark.read.schema(said.schema).parquet(f"{folder}/out").collect()}
    assert found == {(1, "A first sentence here."), (1, "And a rest"), (3, "Far later words")}
