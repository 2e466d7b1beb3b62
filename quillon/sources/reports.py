"""Where results go: chunk tables and reports as JSON lines, JSON or Markdown, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_chunks(chunks: DataFrame, path: str, *, by: str = "document_id") -> None:
    """JSON lines, a folder for each document; a document's rows may fill several files."""
    chunks.write.partitionBy(by).option("ignoreNullFields", "false").json(path)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Chunks with the types they were written from; rows that don't parse are an error."""
    typed = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return typed.select(*schema.names)


def write_lines(report: DataFrame, path: str) -> None:
    """One JSON object for each row, e.g. for each query of an evaluation."""
    report.write.option("ignoreNullFields", "false").json(path)


def _cell(column: str) -> Column:
    shown = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.replace(F.replace(shown, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_row(columns: list[str]) -> Column:
    """A row's cells between bars."""
    cells = F.concat_ws(" | ", *(_cell(c) for c in columns))
    return F.concat(F.lit("| "), cells, F.lit(" |"))


def write_markdown(report: DataFrame, path: str, title: str, order: list[str]) -> None:
    """A titled table in one text file. Reports are summaries: one row for a system or document."""
    spark = report.sparkSession
    head = [f"# {title}", "", f"| {' | '.join(report.columns)} |", "|---" * len(report.columns) + "|"]
    top = spark.createDataFrame([(i, line) for i, line in enumerate(head)], "n bigint, line string")
    numbered = report.orderBy(*order).select(
        (F.monotonically_increasing_id() + len(head)).alias("n"), *report.columns
    )
    body = numbered.select("n", markdown_row(report.columns).alias("line"))
    top.unionByName(body).orderBy("n").select("line").coalesce(1).write.text(path)
