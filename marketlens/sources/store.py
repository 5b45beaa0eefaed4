"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only in local mode, where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark, "_marketlens_tables", None) or "file://" + tempfile.mkdtemp(prefix="marketlens-tables-")
        spark._marketlens_tables = path
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: it is computed once, its lineage is cut, and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/core-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that a task sorts or gathers, narrow ones and wide ones.
PARTITION_ROWS, WIDE_ROWS = 1 << 17, 1 << 16


def partitions(df: DataFrame, rows: int | None = None) -> int:
    """Partitions of about so many rows of df, PARTITION_ROWS by default. Rows are counted: a table of files is, by what its files say of themselves."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or PARTITION_ROWS)))


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to so many partitions, so that the memory of a task doesn't grow with the input."""
    return df.repartition(partitions(df), *keys)
