"""Readers of CSV, JSON Lines and JSON files, and of folders of review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgrain.functions import status
from webgrain.functions.base import trim


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Cells as trimmed texts, missing ones ''; names trimmed; rows with blank cells only go.

    With columns, these and no others, in this order; those that the file lacks are ''.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    named = raw.toDF(*(c.strip() for c in raw.columns))
    cells = named.select(*(trim(F.col(f"`{c}`")).alias(c) for c in named.columns))
    kept = cells.filter(F.exists(F.array(*(F.col(f"`{c}`") for c in cells.columns)), lambda c: c != ""))
    if columns is None:
        return kept
    return kept.select(*(F.col(f"`{c}`") if c in kept.columns else F.lit("").alias(c) for c in columns))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): blank lines are skipped, lines that are no JSON are kept apart with their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name")).filter(trim(F.col("value")) != "")
    parsed = lines.withColumn("good", F.try_parse_json("value").isNotNull())
    rows = parsed.filter("good").select(F.from_json("value", schema).alias("r"), "file_name").select("r.*", "file_name")
    return rows, parsed.filter("NOT good").select("file_name", "value")


def read_json_rows(spark: SparkSession, path: str, field: str = "rows") -> DataFrame:
    """The items of a list in a whole-file JSON document."""
    return spark.read.json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")


def read_review_queues(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """All batch files of a folder as one table, with their run ids; manual and combined files are left out."""
    raw = spark.read.csv(glob, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    name, start = F.col("_metadata.file_name"), F.col("_metadata.file_block_start")
    cells = raw.select(*(trim(F.col(f"`{c}`")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns), name.alias("file_name"), start.alias("file_block_start"))
    batch = cells.filter(~F.col("file_name").rlike("manual|combined"))
    return batch.withColumns({"run_id": status.run_id_of(F.col("file_name")), "source_review_queue": F.col("file_name")})
