"""Keeping a stored index in step with the chunks: what is new, changed, stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def changes(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, status): new, changed, unchanged or stale, by content hash."""
    w = wanted.select("id", F.col("content_hash").alias("_w"))
    e = existing.select("id", F.col("content_hash").alias("_e"))
    return w.join(e, "id", "full").select(
        "id",
        F.when(F.col("_e").isNull(), "new")
        .when(F.col("_w").isNull(), "stale")
        .when(F.col("_w") != F.col("_e"), "changed")
        .otherwise("unchanged")
        .alias("status"),
    )


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next snapshot: incoming rows replace stored ones of the same id, never double them."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("id").orderBy(F.col("_new").desc(), F.col("content_hash").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def delete(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti")


def sync(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored rows after one indexing run: changed ones replaced, new ones added, stale ones gone."""
    status = changes(wanted, stored)
    todo = wanted.join(status.where("status in ('new', 'changed')"), "id", "left_semi")
    stale = status.where("status = 'stale'")
    return upsert(delete(stored, stale), todo)


def stored_dimension(spark: SparkSession, path: str, vector: str) -> int | None:
    """Size of the vectors of the collection at ``path``; None if there is none."""
    try:
        live = spark.read.parquet(path)
    except AnalysisException:
        return None
    first = live.select(F.size(vector).alias("n")).first()
    return None if first is None else first["n"]


def append_checked(df: DataFrame, path: str, *, vector: str) -> None:
    """Adds rows to a live collection if their vectors have its size."""
    live = stored_dimension(df.sparkSession, path, vector)
    if live is not None and not df.where(F.size(vector) != live).isEmpty():
        raise ValueError(f"vectors that aren't of the collection's size, {live}")
    df.write.mode("append").parquet(path)


def checked_write(
    df: DataFrame, path: str, *, vector: str | None = None, dimension: int | None = None,
    recreate: bool = False,
) -> None:
    """Write a collection: never an empty one, never vectors of another size over existing ones.

    The size is the one asked for or, where a collection is live at ``path``, that of its vectors;
    only ``recreate`` may change it.
    """
    if vector and dimension is None and not recreate:
        dimension = stored_dimension(df.sparkSession, path, vector)
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *([F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")] if vector else []),
    ).first()
    if facts["n"] == 0:
        raise ValueError("an empty collection never replaces a live one")
    if vector and dimension is not None and (facts["lo"] != dimension or facts["hi"] != dimension):
        raise ValueError(f"vectors of size {facts['lo']}..{facts['hi']}, expected {dimension}")
    df.write.mode("overwrite" if recreate else "errorifexists").parquet(path)
