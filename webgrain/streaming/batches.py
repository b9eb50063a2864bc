"""Review batches as a stream: each new file updates the best row of its sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webgrain.operators.merge import attempt_key, best_attempt


def read_batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, one or more for each trigger."""
    return spark.readStream.schema(schema).parquet(folder)


def keep_best(batches: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the best attempt of each site in a table that each micro-batch rewrites.

    A micro-batch writes a new version beside the old one, named by its number; a
    batch that runs again overwrites its own version, so a restart repeats nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            old = batch.sparkSession.read.parquet(f"{table_path}/version={number - 1}").drop("attempt_key", "n_attempts")
            rows = old.unionByName(batch)
        best_attempt(rows, attempt_key()).write.mode("overwrite").parquet(f"{table_path}/version={number}")

    return batches.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time_col: str = "ts", kind_col: str = "event_type", every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window; rows later than the watermark are left out of a stream."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, every), kind_col).agg(F.count("*").alias("n"))
