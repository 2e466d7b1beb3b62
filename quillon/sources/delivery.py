"""Status reports of calls and messages, as rows or as a stream of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.wording import CALL_STATUS, DETAIL_CHARS, MESSAGE_STATUS, lookup

CALL_REPORT = "CallSid string, Status string"
MESSAGE_REPORT = (
    "whatsapp struct<messages:array<struct<callback_type:string,sid:string,"
    "exo_status_code:string,exo_detailed_status:string>>>"
)


def call_updates(reports: DataFrame, body: str = "body") -> DataFrame:
    """(…, provider_sid, status, detail) of call reports with a known outcome."""
    parsed = reports.withColumn("_r", F.from_json(body, CALL_REPORT))
    status = lookup(CALL_STATUS, F.lower("_r.Status"))
    kept = [c for c in reports.columns if c != body]
    return parsed.select(
        *kept, F.col("_r.CallSid").alias("provider_sid"), status.alias("status"),
        F.lit(None).cast("string").alias("detail"),
    ).where("provider_sid != '' and status is not null")


def message_updates(reports: DataFrame, body: str = "body") -> DataFrame:
    """Delivery reports only; an unknown or unreadable code is a failure with its detail."""
    kept = [c for c in reports.columns if c != body]
    messages = reports.select(
        *kept, F.explode(F.from_json(body, MESSAGE_REPORT)["whatsapp"]["messages"]).alias("_m")
    ).where("_m.callback_type = 'dlr' and _m.sid != ''")
    code = F.coalesce(F.expr("try_cast(_m.exo_status_code as int)"), F.lit(0))
    status = lookup(MESSAGE_STATUS, code)
    return messages.select(
        *kept, F.col("_m.sid").alias("provider_sid"),
        F.coalesce(status, F.lit("failed")).alias("status"),
        F.when(
            status.isNull(),
            F.substring(F.coalesce("_m.exo_detailed_status", F.lit("None")), 1, DETAIL_CHARS),
        ).alias("detail"),
    )
