"""Writers. Each writes a folder of part files, as Spark does."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths that published data may go to, and names that may never be published.
PUBLIC_PATH, PRIVATE_NAME = r"(^|/)(published|public)(/|$)", r"metabase|partner|raw_export"


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns in a fixed order; cells are quoted only where they must be."""
    out = df.select(*(columns or df.columns))
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=False, emptyValue="", nullValue="")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def may_publish(path: str) -> bool:
    """Whether a path is one for published data and no private name occurs in it."""
    return bool(re.search(PUBLIC_PATH, path)) and not re.search(PRIVATE_NAME, path)


def publish(df: DataFrame, path: str) -> None:
    """Write rows as JSON to a public path; others are refused."""
    if not may_publish(path):
        raise ValueError(f"not a path for published data: {path}")
    df.write.mode("overwrite").json(path)


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    """Add a coverage snapshot to the table of snapshots."""
    snapshot.withColumn("taken_at", F.current_timestamp()).write.mode("append").parquet(path)
