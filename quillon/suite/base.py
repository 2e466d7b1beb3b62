"""The registry of queries over the driver's tables and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    job: Job
    sql: str | None
    covers: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, covers: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(name, job, sql, covers)
        return job

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
