"""Send-once ledger and delivery status as streaming sinks of plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quillon.operators.alerts import latest_status, unclaimed


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def claim_batch(ledger_path: str, stream: str):
    """A ``foreachBatch`` function: claims what was never claimed and appends it.

    ``stream`` names the stream run, e.g. by its checkpoint: claims are stored under it and the
    batch's number. A batch that is run again after a failure replaces its own claims and sees all
    others, those of earlier runs with other checkpoints included.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = read_or_none(spark, ledger_path)
        own = (F.col("stream") == stream) & (F.col("batch") == number)
        earlier = (
            batch.select("dedupe_key").limit(0)
            if known is None
            else known.where(~own).select("dedupe_key")
        )
        unclaimed(batch, earlier).write.mode("overwrite").parquet(
            f"{ledger_path}/stream={stream}/batch={number}"
        )

    return run


def upsert_batch(path: str, keys: list[str], order: str):
    """A ``foreachBatch`` function: the table at ``path`` keeps the last row of each key.

    Each batch writes a new version, from the version of the batch before it; a batch that is run
    again writes its version again. ``order`` decides between rows of one batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = F.struct(F.lit(1).alias("new"), order)
        rows = batch.withColumn("_at", first)
        held = current_version(spark, path, number - 1)
        if held is not None:
            rows = rows.unionByName(held.withColumn("_at", F.struct(F.lit(0).alias("new"), order)))
        kept = F.max_by(F.struct(*batch.columns), "_at").alias("row")
        rows.groupBy(*keys).agg(kept).select("row.*").write.mode("overwrite").parquet(
            f"{path}/version={number}"
        )

    return run


def current_version(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The newest version of an upserted table, or that of batch ``upto`` and before."""
    versions = read_or_none(spark, path)
    if versions is None:
        return None
    numbers = versions.select("version").distinct()
    if upto is not None:
        numbers = numbers.where(F.col("version") <= upto)
    newest = numbers.agg(F.max("version")).first()[0]
    return None if newest is None else versions.where(F.col("version") == newest).drop("version")


def status_batch(updates_path: str):
    """A ``foreachBatch`` function: keeps every status report, one folder for each batch."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates_path}/batch={number}")

    return run


def current_status(deliveries: DataFrame, updates_path: str, order: list[str]) -> DataFrame:
    """Deliveries with the newest reported status so far."""
    updates = read_or_none(deliveries.sparkSession, updates_path)
    return deliveries if updates is None else latest_status(deliveries, updates, order)
