"""Session set-up and the shared working folder."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of this package is happy with. They only switch on what
# Spark already offers: run-time re-planning, skew splitting and partition coalescing.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Tables stored since ``settled`` began, if it did.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of a cluster that doesn't have it installed."""
    folder = tempfile.mkdtemp(prefix="quillon-package-")
    archive = shutil.make_archive(f"{folder}/quillon", "zip", PACKAGE.parent, PACKAGE.name)
    spark.sparkContext.addPyFile(archive)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. Clusters bring their own."""
    # Python workers start with the environment of the session, whatever the working folder is.
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(PACKAGE.parent) not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([str(PACKAGE.parent), *filter(None, known)])
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read and write: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that what follows starts from stored rows.

    Used where a result feeds several branches or several rounds: the lineage ends here and
    a lost executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns as a stored table; tables that were stored on the way to it are removed."""
    token = _made.set([])
    try:
        out = written(make(), name)
        on_the_way = [table for table in _made.get() if table is not out]
    finally:
        _made.reset(token)
    if (made := _made.get()) is not None:
        made.append(out)
    discard(*on_the_way)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that only fed tables written since, and the shuffles behind them.

    Spark keeps a shuffle's files until the driver's garbage is collected, which a driver with little
    to do may not need for hours.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        if (made := _made.get()) is not None:
            made[:] = [other for other in made if other is not table]
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()
