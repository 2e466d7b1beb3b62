"""Reminders: what is due at an instant, to whom, by which channel, and what was sent."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.wording import (
    clock_iso, dedupe_key, first_name, joined_labels, medicine_label, mobile_number,
)

ALERTS_A_DAY = 3
WINDOW_SECONDS = 300
LOW_STOCK_DAYS = 7
LOW_STOCK_HOUR = 10


@dataclass(frozen=True)
class ReminderTables:
    """The relational source. An absent access table is an error: nobody is reminded by default."""

    alerts: DataFrame
    medications: DataFrame
    clients: DataFrame
    settings: DataFrame
    access: DataFrame

    def __post_init__(self) -> None:
        if self.access is None:
            raise ValueError("reminders need the access table")


def in_quiet_hours(at: Column, start: Column, end: Column) -> Column:
    """Half-open and may wrap over midnight; unset or empty hours are never quiet."""
    inside = F.when(start < end, (at >= start) & (at < end)).otherwise((at >= start) | (at < end))
    return F.coalesce(F.when(start != end, inside), F.lit(False))


def due_window(now_seconds: int, window: int = WINDOW_SECONDS) -> tuple[int, int]:
    """The last minutes up to now, cut short at midnight."""
    return max(0, now_seconds - window), now_seconds


def counted_times(alerts: DataFrame, keep: int = ALERTS_A_DAY) -> DataFrame:
    """(client_id, time_s) of each client's earliest distinct alert times."""
    times = alerts.where("enabled and time_s is not null").select("client_id", "time_s").distinct()
    order = Window.partitionBy("client_id").orderBy("time_s")
    return times.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def due_reminders(
    tables: ReminderTables, today: date, now_seconds: int, window: int = WINDOW_SECONDS
) -> DataFrame:
    """One row for each client and time in the window, naming every medicine due then."""
    low, high = due_window(now_seconds, window)
    due = tables.alerts.where("enabled").where(F.col("time_s").between(low, high))
    due = due.join(tables.access.select("client_id"), "client_id", "left_semi")
    # Which times count is worked out for the clients that have something due.
    clients = due.select("client_id").distinct()
    counted = counted_times(tables.alerts.join(clients, "client_id", "left_semi"))
    due = due.join(counted, ["client_id", "time_s"], "left_semi")
    s = tables.settings.select(
        "client_id", "reminders", "quiet_start_s", "quiet_end_s", "paused_until",
        "whatsapp_enabled", "whatsapp_number", "calls_enabled", "call_number",
    )
    due = due.join(s, "client_id", "left").where(
        F.coalesce("reminders", F.lit(True))
        & (F.col("paused_until").isNull() | (F.col("paused_until") < F.lit(today)))
    )
    m = tables.medications.select(
        F.col("id").alias("medication_id"), medicine_label(F.col("name"), F.col("strength")).alias("label")
    )
    c = tables.clients.select(
        F.col("id").alias("client_id"), first_name(F.col("full_name")).alias("first_name"),
        F.coalesce("language", F.lit("en")).alias("language"),
    )
    settings = ["whatsapp_enabled", "whatsapp_number", "calls_enabled", "call_number",
                "quiet_start_s", "quiet_end_s"]
    # Repeated labels of a client and time shrink to one row before they are listed.
    labelled = (
        due.join(m, "medication_id", "left")
        .withColumn("label", F.coalesce("label", F.lit("your medicine")))
        .groupBy("client_id", "time_s", "label", *settings)
        .agg(
            F.min(F.struct(F.col("id").alias("alert_id"), "medication_id")).alias("_first"),
        )
    )
    grouped = labelled.groupBy("client_id", "time_s", *settings).agg(
        F.min("_first").alias("_first"), F.collect_list("label").alias("_labels")
    )
    return grouped.join(c, "client_id", "left").select(
        "_first.alert_id", "client_id", "_first.medication_id",
        F.coalesce("first_name", F.lit("there")).alias("first_name"),
        F.coalesce("language", F.lit("en")).alias("language"),
        joined_labels(F.col("_labels")).alias("label"),
        F.size("_labels").alias("medicines"),
        "time_s",
        F.when(F.col("whatsapp_enabled"), F.col("whatsapp_number")).alias("whatsapp_number"),
        F.when(F.col("calls_enabled"), F.col("call_number")).alias("phone"),
        in_quiet_hours(F.col("time_s"), F.col("quiet_start_s"), F.col("quiet_end_s")).alias("quiet"),
    )


def reminder_decisions(due: DataFrame, today: date) -> DataFrame:
    """One row for each reminder and switched-on channel: send or skip, to which number."""
    channels = F.filter(
        F.array(
            F.struct(F.lit("whatsapp").alias("channel"), F.col("whatsapp_number").alias("number")),
            F.struct(F.lit("call").alias("channel"), F.col("phone").alias("number")),
        ),
        lambda c: F.coalesce(c["number"], F.lit("")) != "",
    )
    rows = due.withColumn("_c", F.explode(channels)).select(*due.columns, "_c.*")
    to = mobile_number(F.col("number"))
    target = F.when((F.col("channel") == "call") & F.col("quiet"), None).otherwise(to)
    return rows.select(
        "client_id", "alert_id", "medication_id", "channel", "first_name", "label", "time_s",
        target.alias("to"),
        F.when(target.isNull(), "skip").otherwise("send").alias("decision"),
        dedupe_key(
            "dose", F.col("client_id").cast("string"), today.isoformat(), clock_iso(F.col("time_s")),
            F.col("channel"),
        ).alias("dedupe_key"),
    )


def low_stock(tables: ReminderTables, today: date) -> DataFrame:
    """One row for each client with medicines running out: their labels and the fewest days left."""
    s = tables.settings.select(
        "client_id", "low_stock_alerts", "low_stock_days", "whatsapp_enabled", "whatsapp_number"
    )
    m = tables.medications.where("quantity is not null").join(
        tables.access.select("client_id"), "client_id", "left_semi"
    )
    dose = F.when(F.coalesce("dose", F.lit(0)) == 0, 1.0).otherwise(F.col("dose"))
    times = F.when(F.coalesce("times_per_day", F.lit(0)) == 0, 1).otherwise(F.col("times_per_day"))
    per_day = dose * times
    threshold = F.coalesce(F.nullif("low_stock_days", F.lit(0)), F.lit(LOW_STOCK_DAYS))
    low = (
        m.join(s, "client_id", "left")
        .where(F.coalesce("low_stock_alerts", F.lit(True)))
        .withColumn("_per_day", per_day)
        .where("_per_day > 0")
        .withColumn("days_left", F.floor(F.col("quantity") / F.col("_per_day")).cast("bigint"))
        .where(F.col("days_left") <= threshold)
        .withColumn("label", medicine_label(F.col("name"), F.col("strength")))
    )
    number = F.when(F.col("whatsapp_enabled"), F.col("whatsapp_number"))
    by_label = low.groupBy("client_id", "label", number.alias("whatsapp_number")).agg(
        F.min("id").alias("medication_id"), F.min("days_left").alias("days_left")
    )
    by_client = by_label.groupBy("client_id", "whatsapp_number").agg(
        F.min("medication_id").alias("medication_id"),
        joined_labels(F.collect_list("label")).alias("label"),
        F.min("days_left").alias("days_left"),
    )
    c = tables.clients.select(
        F.col("id").alias("client_id"), first_name(F.col("full_name")).alias("first_name")
    )
    to = mobile_number(F.col("whatsapp_number"))
    return by_client.join(c, "client_id", "left").select(
        "client_id", "medication_id", F.coalesce("first_name", F.lit("there")).alias("first_name"),
        "label", "days_left", to.alias("to"),
        F.when(to.isNull(), "skip").otherwise("send").alias("decision"),
        dedupe_key("low", F.col("client_id").cast("string"), today.isoformat(), "whatsapp").alias("dedupe_key"),
    )


def unclaimed(decisions: DataFrame, ledger: DataFrame) -> DataFrame:
    """What is to be sent and was never claimed: a key claims once, ever."""
    return decisions.where("decision = 'send'").join(
        ledger.select("dedupe_key"), "dedupe_key", "left_anti"
    ).dropDuplicates(["dedupe_key"])


def run_counters(due: DataFrame, decisions: DataFrame, ledger: DataFrame) -> DataFrame:
    """due, sent by channel, skipped: one row for a run."""
    sent = unclaimed(decisions, ledger).agg(
        F.count(F.when(F.col("channel") == "whatsapp", 1)).alias("whatsapp"),
        F.count(F.when(F.col("channel") == "call", 1)).alias("calls"),
    )
    skipped = decisions.agg(F.count(F.when(F.col("decision") == "skip", 1)).alias("skipped"))
    one = F.lit(1).alias("_one")
    return (
        due.agg(F.count(F.lit(1)).alias("due")).select("*", one)
        .join(sent.select("*", one), "_one")
        .join(skipped.select("*", one), "_one")
        .drop("_one")
    )


def call_context(deliveries: DataFrame, tables: ReminderTables) -> DataFrame:
    """For each call delivery: who is called, and every medicine the person takes at that time."""
    label = medicine_label(F.col("name"), F.col("strength"))
    calls = deliveries.where("channel = 'call'").select(
        F.col("id").alias("delivery_id"), "client_id", "alert_id", "medication_id"
    )
    at = tables.alerts.select(F.col("id").alias("alert_id"), "time_s")
    own = tables.medications.select(F.col("id").alias("medication_id"), label.alias("own_label"))
    calls = calls.join(at, "alert_id", "left").join(own, "medication_id", "left")
    wanted = calls.where("time_s is not null").select("client_id", "time_s").distinct()
    same = (
        tables.alerts.where("enabled")
        .join(wanted, ["client_id", "time_s"], "left_semi")
        .join(tables.medications.select(F.col("id").alias("medication_id"), label.alias("label")), "medication_id")
        .select("client_id", "time_s", "label")
        .distinct()
        .groupBy("client_id", "time_s")
        .agg(F.collect_list("label").alias("_labels"))
    )
    c = tables.clients.select(
        F.col("id").alias("client_id"), first_name(F.col("full_name")).alias("first_name"), "language"
    )
    many = F.coalesce(F.size("_labels"), F.lit(0)) > 1
    return (
        calls.join(same, ["client_id", "time_s"], "left")
        .join(c, "client_id", "left")
        .select(
            "delivery_id", F.coalesce("first_name", F.lit("there")).alias("first_name"),
            F.coalesce("language", F.lit("en")).alias("language"), "time_s",
            F.when(many, joined_labels(F.col("_labels")))
            .otherwise(F.coalesce("own_label", F.lit("your medicine")))
            .alias("label"),
            F.when(many, F.size("_labels")).otherwise(1).alias("count"),
        )
    )


def latest_status(deliveries: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """Deliveries with the newest status reported for their provider id; nulls overwrite nothing."""
    at = F.struct(*order)
    newest = updates.groupBy("provider_sid").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("_status"),
        F.max_by("detail", F.when(F.col("detail").isNotNull(), at)).alias("_detail"),
    )
    return deliveries.join(newest, "provider_sid", "left").select(
        *[c for c in deliveries.columns if c not in ("status", "detail")],
        F.coalesce("_status", "status").alias("status"),
        F.coalesce("_detail", "detail").alias("detail"),
    )
