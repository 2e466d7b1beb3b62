"""Small helpers of the operators here: task-side folders, word splitting, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.session import shared_dir

# What counts as white space (the White_Space property of Unicode).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as zstd Parquet in the shared folder: lineage ends, lost executors cost a re-read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null text gives none."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def row_by_row(df: DataFrame, fields: str, work: Callable[..., tuple]) -> DataFrame:
    """The first column of ``df`` as it is, and what ``work`` makes of the others in each row.

    ``fields`` declares what ``work`` returns. Rows go through Arrow batches; none meet.
    """
    kind = df.schema[0].dataType.simpleString()
    declared = T.StructType.fromDDL(f"{df.columns[0]} {kind}, {fields}")
    schema = to_arrow_schema(declared)
    inputs = range(1, len(df.columns))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = (batch.column(i).to_pylist() for i in inputs)
            rows = [work(*value) for value in zip(*values, strict=True)]
            made = [
                pa.array(column, type=field.type)
                for column, field in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema=schema)

    return df.mapInArrow(body, declared)
