"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contract: a word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: an executor and its Python worker hold each batch of texts once, some MB of texts of a few kB.
ARROW_ROWS = 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark, "_marketlens_shared", None) or "file://" + tempfile.mkdtemp(prefix="marketlens-")
        spark._marketlens_shared = path
    return path.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """ARROW_ROWS rows a batch at most for the plans made inside; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = int(before)
    spark.conf.set(key, str(min(rows, ARROW_ROWS) if rows > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, gives true sizes to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marketlens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more: what came of them is itself a written table."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table._marketlens_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """name, lengthened until it clashes with no column (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """Number of words of a text column, 0 for null."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
