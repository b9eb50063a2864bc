"""Small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder.

    Only where the session names none (as in local tests) is a folder of our
    own set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="webgrain-checkpoints-"))
    return sc.getCheckpointDir()


#: With this setting Spark deletes a query's shuffle files when the query ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For rows of megabytes: Parquet looks at the sizes of pages only after a hundred rows by default, and a read takes all rows of a row group at once.
LARGE_ROWS = {"parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def cut(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet (with the writer's options) into the shared folder and read it back.

    Later jobs then depend on replicated files and not on the lineage, so a
    lost executor costs no recomputation of what lies before the cut. Shuffle
    files of what lies before it are of no more use and go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(compression="zstd", **(options or {})).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing will read any more."""
    for df in cuts:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a document row, from its id and its text.

    Rows that agree in both are one document to the operators that use the key.
    """
    return F.xxhash64(
        F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")),
        F.coalesce(F.col(text_col), F.lit("\x00null")),
    )


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id falls in fold 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(1).cast("long"))


#: So many rows of keys (a few numbers each) are broadcast; more are shuffled.
MAX_KEYS = 1 << 21


def few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are counted to be few."""
    return F.broadcast(keys) if keys.limit(MAX_KEYS + 1).count() <= MAX_KEYS else keys


def without_keys(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose row_key is in keys (one column row_key)."""
    keyed = docs.withColumn("_key", row_key(id_col, text_col))
    return keyed.join(few(keys.withColumnRenamed("row_key", "_key")), "_key", "left_anti").select(*docs.columns)
