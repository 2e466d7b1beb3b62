"""Reminders over customers, orders and parts; deliveries from events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import wording as W
from quillon.operators import alerts as A
from quillon.sources.delivery import call_updates, message_updates
from quillon.suite.base import register, table

TODAY = date(1998, 6, 1)
NOW = 8 * 3600 + 120


def tables(spark: SparkSession, sf: str) -> A.ReminderTables:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    # Order and line number do not identify a line here: the first of each pair is kept.
    first = F.min(F.struct("l_partkey", "l_quantity")).alias("_l")
    lines = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(first)
        .select("l_orderkey", "l_linenumber", "_l.*")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    )
    slot = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4), 16, 10).cast("int")
    return A.ReminderTables(
        alerts=lines.select(
            "id", F.col("o_custkey").alias("client_id"), F.col("id").alias("medication_id"),
            (slot % 96 * 900).alias("time_s"), (F.col("l_linenumber") % 5 != 0).alias("enabled"),
        ),
        medications=lines.select(
            "id", F.col("o_custkey").alias("client_id"), F.col("p_name").alias("name"),
            F.when(F.col("p_size") % 5 != 0, F.concat("p_size", F.lit(" mg"))).alias("strength"),
            (F.col("l_linenumber") % 2 + 1).cast("double").alias("dose"),
            F.col("l_quantity").cast("double").alias("quantity"),
            (F.col("l_linenumber") % 3).alias("times_per_day"),
        ),
        clients=c.select(
            k.alias("id"), F.regexp_replace("c_name", "#", " ").alias("full_name"),
            F.when(k % 3 == 0, "hi").when(k % 3 == 1, "en").alias("language"),
        ),
        settings=c.where(k % 7 != 0).select(
            k.alias("client_id"),
            F.when(k % 13 != 0, k % 11 != 0).alias("reminders"),
            F.when(k % 3 == 0, 22 * 3600).alias("quiet_start_s"),
            F.when(k % 2 == 0, 9 * 3600).otherwise(7 * 3600).alias("quiet_end_s"),
            F.when(k % 17 == 0, F.lit(date(1998, 6, 1))).when(k % 17 == 1, F.lit(date(1998, 5, 31))).alias("paused_until"),
            (k % 2 == 0).alias("whatsapp_enabled"),
            F.concat(F.lit("98765 "), F.lpad(k.cast("string"), 5, "0")).alias("whatsapp_number"),
            (k % 3 == 0).alias("calls_enabled"),
            F.when(k % 5 == 1, "0000000000").otherwise(
                F.concat(F.lit("+91 8"), F.lpad(k.cast("string"), 9, "1"))
            ).alias("call_number"),
            F.when(k % 19 != 0, F.lit(True)).otherwise(False).alias("low_stock_alerts"),
            F.when(k % 4 == 0, (k % 10).cast("int")).alias("low_stock_days"),
        ),
        access=c.where(k % 5 != 0).select(k.alias("client_id")),
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Some clients already had this morning's message."""
    return table(spark, sf, "customer").where("c_custkey % 4 = 0").select(
        F.concat(F.lit("dose:"), "c_custkey", F.lit(":1998-06-01:08:00:00:whatsapp")).alias("dedupe_key")
    )


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with a multiple-of-three number as a delivery of its alert."""
    t = tables(spark, sf).alerts
    return t.select(
        F.concat(F.lit("d"), "id").alias("id"), "client_id", F.col("id").alias("alert_id"), "medication_id",
        F.when(F.col("id") % 3 == 0, "call").otherwise("whatsapp").alias("channel"),
        F.concat(F.lit("sid"), F.col("id") % 1000).alias("provider_sid"),
        F.lit("sent").alias("status"), F.lit(None).cast("string").alias("detail"),
    )


# --- SQL -------------------------------------------------------------------------------------

TABLES = """
lines AS (SELECT l_orderkey * 10 + l_linenumber AS id, * FROM (SELECT * FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1)
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
alerts AS (SELECT id, o_custkey AS client_id, id AS medication_id, ('0x' || substring(md5(o_orderkey::VARCHAR), 1, 4))::INT % 96 * 900 AS time_s,
  l_linenumber % 5 <> 0 AS enabled FROM lines),
meds AS (SELECT id, o_custkey AS client_id, p_name || CASE WHEN p_size % 5 <> 0 THEN ' ' || p_size || ' mg' ELSE '' END AS label,
  (l_linenumber % 2 + 1) * CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_linenumber % 3 END AS per_day, l_quantity AS quantity FROM lines),
clients AS (SELECT c_custkey AS client_id, split_part(c_name, '#', 1) AS first_name,
  CASE c_custkey % 3 WHEN 0 THEN 'hi' ELSE 'en' END AS language FROM customer),
settings AS (SELECT c_custkey AS client_id, NOT (c_custkey % 13 <> 0 AND c_custkey % 11 = 0) AS reminders,
  CASE WHEN c_custkey % 3 = 0 THEN 79200 END AS qs, CASE WHEN c_custkey % 2 = 0 THEN 32400 ELSE 25200 END AS qe,
  CASE c_custkey % 17 WHEN 0 THEN DATE '1998-06-01' WHEN 1 THEN DATE '1998-05-31' END AS paused,
  CASE WHEN c_custkey % 2 = 0 THEN '98765 ' || lpad(c_custkey::VARCHAR, 5, '0') END AS wa,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 5 = 1 THEN '0000000000' ELSE '+91 8' || lpad(c_custkey::VARCHAR, 9, '1') END END AS ph,
  c_custkey % 19 <> 0 AS low_on, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 10 <> 0 THEN c_custkey % 10 ELSE 7 END AS low_days
  FROM customer WHERE c_custkey % 7 <> 0),
access AS (SELECT c_custkey AS client_id FROM customer WHERE c_custkey % 5 <> 0)"""
TOGETHER = "CASE WHEN len(ls) = 1 THEN ls[1] ELSE array_to_string(ls[:-2], ', ') || ' and ' || ls[-1] END"
DUE = f"""
times AS (SELECT client_id, time_s FROM (SELECT DISTINCT client_id, time_s FROM alerts WHERE enabled)
  QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY time_s) <= 3),
raw AS (SELECT a.*, m.label, s.* EXCLUDE (client_id) FROM alerts a JOIN access USING (client_id) JOIN times USING (client_id, time_s)
  JOIN meds m ON m.id = a.medication_id LEFT JOIN settings s USING (client_id)
  WHERE enabled AND time_s BETWEEN 28620 AND 28920 AND coalesce(reminders, true) AND (paused IS NULL OR paused < DATE '1998-06-01')),
due AS (SELECT min(id) AS alert_id, client_id, min(id) AS medication_id, any_value(first_name) AS first_name, any_value(language) AS language,
    list_sort(list_distinct(list(label))) AS ls, time_s, any_value(wa) AS whatsapp_number, any_value(ph) AS phone,
    coalesce(any_value(CASE WHEN qs IS NULL THEN false WHEN qs < qe THEN time_s >= qs AND time_s < qe ELSE time_s >= qs OR time_s < qe END), false) AS quiet
  FROM raw JOIN clients USING (client_id) GROUP BY client_id, time_s)"""


def mobile_sql(n: str) -> str:
    digits = rf"regexp_replace({n}, '\D', '', 'g')"
    return f"CASE WHEN regexp_matches(right({digits}, 10), '^[6-9][0-9]{{9}}$') THEN '+91' || right({digits}, 10) END"


DECISIONS = f"""
channels AS (SELECT *, 'whatsapp' AS channel, {mobile_sql('whatsapp_number')} AS target FROM due WHERE whatsapp_number IS NOT NULL
  UNION ALL SELECT *, 'call', CASE WHEN NOT quiet THEN {mobile_sql('phone')} END FROM due WHERE phone IS NOT NULL),
decisions AS (SELECT client_id, alert_id, channel, target, CASE WHEN target IS NULL THEN 'skip' ELSE 'send' END AS decision,
  'dose:' || client_id || ':1998-06-01:' || printf('%02d:%02d:%02d', time_s // 3600, time_s % 3600 // 60, time_s % 60) || ':' || channel AS dedupe_key FROM channels),
ledger AS (SELECT 'dose:' || c_custkey || ':1998-06-01:08:00:00:whatsapp' AS dedupe_key FROM customer WHERE c_custkey % 4 = 0)"""


@register(
    "due_reminders", "J7 W3 A22 P14 P17 P20 S17 R12 H27",
    f"WITH {TABLES},{DUE} SELECT * EXCLUDE (ls), {TOGETHER} AS label, len(ls) AS medicines FROM due",
)
def due_reminders(spark: SparkSession, sf: str) -> DataFrame:
    return A.due_reminders(tables(spark, sf), TODAY, NOW)


@register(
    "reminder_decisions", "P12 P18 H33",
    f"WITH {TABLES},{DUE},{DECISIONS} SELECT client_id, alert_id, channel, target AS \"to\", decision, dedupe_key FROM decisions",
)
def reminder_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.reminder_decisions(A.due_reminders(tables(spark, sf), TODAY, NOW), TODAY)
    return rows.select("client_id", "alert_id", "channel", "to", "decision", "dedupe_key")


@register(
    "unclaimed_sends", "J14 U2",
    f"""WITH {TABLES},{DUE},{DECISIONS} SELECT dedupe_key, client_id, channel FROM decisions WHERE decision = 'send'
      AND dedupe_key NOT IN (SELECT dedupe_key FROM ledger)""",
)
def unclaimed_sends(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.reminder_decisions(A.due_reminders(tables(spark, sf), TODAY, NOW), TODAY)
    return A.unclaimed(rows, ledger(spark, sf)).select("dedupe_key", "client_id", "channel")


@register(
    "reminder_run", "A23",
    f"""WITH {TABLES},{DUE},{DECISIONS} SELECT (SELECT count(*) FROM due) AS due,
      count(*) FILTER (decision = 'send' AND channel = 'whatsapp' AND dedupe_key NOT IN (SELECT dedupe_key FROM ledger)) AS whatsapp,
      count(*) FILTER (decision = 'send' AND channel = 'call' AND dedupe_key NOT IN (SELECT dedupe_key FROM ledger)) AS calls,
      count(*) FILTER (decision = 'skip') AS skipped FROM decisions""",
)
def reminder_run(spark: SparkSession, sf: str) -> DataFrame:
    due = A.due_reminders(tables(spark, sf), TODAY, NOW)
    return A.run_counters(due, A.reminder_decisions(due, TODAY), ledger(spark, sf))


@register(
    "low_stock", "A21 H27",
    f"""WITH {TABLES}, low AS (SELECT m.*, floor(quantity / per_day)::BIGINT AS days, wa FROM meds m JOIN access USING (client_id)
      LEFT JOIN settings USING (client_id) WHERE coalesce(low_on, true) AND floor(quantity / per_day) <= coalesce(low_days, 7)),
    g AS (SELECT client_id, min(id) AS medication_id, list_sort(list_distinct(list(label))) AS ls, min(days) AS days_left, any_value(wa) AS wa FROM low GROUP BY 1)
    SELECT client_id, medication_id, first_name, {TOGETHER} AS label, days_left, {mobile_sql('wa')} AS "to",
      CASE WHEN {mobile_sql('wa')} IS NULL THEN 'skip' ELSE 'send' END AS decision, 'low:' || client_id || ':1998-06-01:whatsapp' AS dedupe_key
    FROM g JOIN clients USING (client_id)""",
)
def low_stock(spark: SparkSession, sf: str) -> DataFrame:
    return A.low_stock(tables(spark, sf), TODAY)


@register(
    "call_contexts", "J12 H32",
    f"""WITH {TABLES}, calls AS (SELECT 'd' || id AS delivery_id, * FROM alerts WHERE id % 3 = 0),
    same AS (SELECT client_id, time_s, list_sort(list_distinct(list(label))) AS ls FROM alerts a JOIN meds m USING (id, client_id) WHERE enabled GROUP BY 1, 2),
    rows AS (SELECT delivery_id, first_name, language, c.time_s, CASE WHEN len(ls) > 1 THEN {TOGETHER} ELSE m.label END AS label,
      CASE WHEN len(ls) > 1 THEN len(ls) ELSE 1 END AS count FROM calls c JOIN meds m USING (id, client_id) JOIN clients USING (client_id)
      LEFT JOIN same s ON s.client_id = c.client_id AND s.time_s = c.time_s)
    SELECT delivery_id, language, count, 'Good day ' || first_name || '. The service calling: ' || label || CASE WHEN count > 1 THEN ' are' ELSE ' is' END || ' due since '
      || CASE WHEN time_s // 3600 % 12 = 0 THEN 12 ELSE time_s // 3600 % 12 END || printf(':%02d ', time_s % 3600 // 60) || CASE WHEN time_s < 43200 THEN 'AM' ELSE 'PM' END
      || '. Is that done already?' AS line FROM rows""",
)
def call_contexts(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.call_context(deliveries(spark, sf), tables(spark, sf))
    line = W.opening_line("The service", F.col("first_name"), F.col("label"), F.col("time_s"), F.col("count"))
    return rows.select("delivery_id", "language", "count", line.alias("line"))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Events as status reports in JSON."""
    e = table(spark, sf, "events")
    sid = F.concat(F.lit("sid"), F.col("event_id") % 1000)
    call = F.to_json(
        F.struct(
            sid.alias("CallSid"),
            F.element_at(
                F.array(*[F.lit(s) for s in ("Completed", "busy", "no-answer", "canceled", "ringing")]),
                (F.col("user_id") % 5 + 1).cast("int"),
            ).alias("Status"),
        )
    )
    code = F.when(F.col("user_id") % 6 == 5, "bad").otherwise((30000 + F.col("user_id") % 5).cast("string"))
    kind = F.when(F.col("user_id") % 7 == 0, "icm").otherwise("dlr")
    message = F.to_json(
        F.struct(
            F.struct(
                F.array(
                    F.struct(
                        kind.alias("callback_type"), sid.alias("sid"), code.alias("exo_status_code"),
                        F.concat(F.lit("detail "), F.col("user_id")).alias("exo_detailed_status"),
                    )
                ).alias("messages")
            ).alias("whatsapp")
        )
    )
    return e.select("event_id", call.alias("call_body"), message.alias("message_body"))


UPDATES = """
updates AS (SELECT event_id, 'sid' || (event_id % 1000) AS provider_sid,
    ['answered', 'no_answer', 'no_answer', 'failed', NULL][user_id % 5 + 1] AS status, NULL::VARCHAR AS detail FROM events WHERE user_id % 5 <> 4
  UNION ALL SELECT event_id, 'sid' || (event_id % 1000), CASE WHEN user_id % 6 <> 5 AND user_id % 5 BETWEEN 1 AND 3 THEN ['sent', 'delivered', 'read'][user_id % 5] ELSE 'failed' END,
    CASE WHEN user_id % 6 <> 5 AND user_id % 5 BETWEEN 1 AND 3 THEN NULL ELSE 'detail ' || user_id END FROM events WHERE user_id % 7 <> 0)"""


def updates(spark: SparkSession, sf: str) -> DataFrame:
    r = reports(spark, sf)
    calls = call_updates(r.select("event_id", F.col("call_body").alias("body")))
    return calls.unionByName(message_updates(r.select("event_id", F.col("message_body").alias("body"))))


@register("status_reports", "S19", f"WITH {UPDATES} SELECT * FROM updates")
def status_reports(spark: SparkSession, sf: str) -> DataFrame:
    return updates(spark, sf)


@register(
    "delivery_status", "J15 R11",
    f"""WITH {TABLES},{UPDATES}, newest AS (SELECT provider_sid, arg_max(status, (event_id, status)) AS s, arg_max(detail, event_id) AS d FROM updates GROUP BY 1)
    SELECT 'd' || id AS id, channel, provider_sid, coalesce(s, 'sent') AS status, d AS detail FROM
      (SELECT id, CASE WHEN id % 3 = 0 THEN 'call' ELSE 'whatsapp' END AS channel, 'sid' || (id % 1000) AS provider_sid FROM alerts) LEFT JOIN newest USING (provider_sid)""",
)
def delivery_status(spark: SparkSession, sf: str) -> DataFrame:
    # Two reports of one event are ordered by their status.
    found = A.latest_status(deliveries(spark, sf), updates(spark, sf), ["event_id", "status"])
    return found.select("id", "channel", "provider_sid", "status", "detail")


@register(
    "phone_numbers", "P12 P13",
    rf"""WITH n AS (SELECT c_custkey, ['98765 ' || lpad(c_custkey::VARCHAR, 5, '0'), '+91-7' || lpad(c_custkey::VARCHAR, 9, '2'), '12-' || c_custkey, NULL][c_custkey % 4 + 1] AS number FROM customer)
    SELECT c_custkey, {mobile_sql('number')} AS mobile, CASE WHEN length(regexp_replace(coalesce(number, ''), '\D', '', 'g')) >= 4
      THEN '***' || right(regexp_replace(number, '\D', '', 'g'), 4) ELSE '***' END AS masked FROM n""",
)
def phone_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    number = F.element_at(
        F.array(
            F.concat(F.lit("98765 "), F.lpad(k.cast("string"), 5, "0")),
            F.concat(F.lit("+91-7"), F.lpad(k.cast("string"), 9, "2")),
            F.concat(F.lit("12-"), k), F.lit(None),
        ),
        (k % 4 + 1).cast("int"),
    )
    return table(spark, sf, "customer").select(
        "c_custkey", W.mobile_number(number).alias("mobile"), W.masked_number(number).alias("masked")
    )


@register(
    "spoken_languages", "H28",
    """WITH v AS (SELECT c_custkey, [' hi-IN', 'Tamil', 'EN', 'xx', 'bengali', 'te-x-y'][c_custkey % 6 + 1] AS said FROM customer)
    SELECT c_custkey, ['hi', 'ta', 'en', NULL, 'bn', 'te'][c_custkey % 6 + 1] AS code FROM v""",
)
def spoken_languages(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(
        F.array(*[F.lit(v) for v in (" hi-IN", "Tamil", "EN", "xx", "bengali", "te-x-y")]),
        (F.col("c_custkey") % 6 + 1).cast("int"),
    )
    return table(spark, sf, "customer").select("c_custkey", W.language_code(said).alias("code"))


@register(
    "clock_texts", "H27 P14",
    """WITH t AS (SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)::INT)::BIGINT AS s FROM events)
    SELECT event_id, CASE WHEN s // 3600 % 12 = 0 THEN 12 ELSE s // 3600 % 12 END || printf(':%02d ', s % 3600 // 60) || CASE WHEN s < 43200 THEN 'AM' ELSE 'PM' END AS clock,
      s >= 79200 OR s < 25200 AS quiet FROM t""",
)
def clock_texts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf, "events").select(
        "event_id", W.clock_text(s).alias("clock"),
        A.in_quiet_hours(s, F.lit(79200), F.lit(25200)).alias("quiet"),
    )
