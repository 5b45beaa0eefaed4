"""Sinks: the raw lake, upserts by key, daily snapshots, receipts of batches, quarantine.

Tables are Parquet folders of versions, of which the last that was written to its end counts. A write that fails leaves
the former version as it was, and a batch with a known digest changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.text import scrubbed


def _names(spark: SparkSession, path: str) -> list[str]:
    """The versions of a table, oldest first, of those that were written to their end."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return []
    done = [s.getPath() for s in files.listStatus(folder)]
    return sorted(p.getName() for p in done if p.getName().startswith("v") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    names = _names(spark, path)
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def _put(rows: DataFrame, path: str) -> str:
    """rows as the next version; Spark marks a folder with _SUCCESS after its last file, and only marked ones count."""
    names = _names(rows.sparkSession, path)
    name = f"v{int(names[-1][1:9]) + 1 if names else 0:08d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(f"{path}/{name}")
    return name


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, that with the largest order; a partial aggregation, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def upsert(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Rows replace those of their keys unless what is there is newer (S19, S20); returns the table."""
    old = current(rows.sparkSession, path)
    both = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
    name = _put(latest(both, keys, order), path)
    return rows.sparkSession.read.parquet(f"{path}/{name}")


def raw(rows: DataFrame, path: str, source: str, day: str, batch: str | None = None) -> str:
    """Raw records under source, day and batch, compressed JSON with its secrets masked; returns the batch's name.

    A batch is named by its content unless the caller does: written twice it is there once, and no batch of a day touches another.
    """
    batch = batch or digest(rows)
    masked = rows.select(*(F.when(F.col(c).isNotNull(), scrubbed(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes))
    masked.write.mode("overwrite").option("compression", "gzip").json(f"{path}/source={source}/day={day}/batch={batch}")
    return batch


def snapshot(rows: DataFrame, path: str, day: str) -> None:
    """One snapshot a day: written again, it replaces that day alone."""
    rows.write.mode("overwrite").parquet(f"{path}/day={day}")


def quarantine(bad: DataFrame, path: str, batch: str) -> None:
    """Refused records with their reasons, secrets masked."""
    bad.select(F.when(F.col("raw").isNotNull(), scrubbed("raw")).alias("raw"), F.array_join("reasons", "; ").alias("reason")).write.mode("overwrite").json(f"{path}/batch={batch}")


def digest(rows: DataFrame) -> str:
    """A name for the content of a batch, whatever the order of its rows."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    n, x, s = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(line)), F.sum(F.xxhash64(line, F.lit(1)).cast("decimal(38,0)"))).first()
    return f"{n}-{(x or 0) & (1 << 64) - 1:016x}-{int(s or 0) & (1 << 64) - 1:016x}"


def ingest_once(rows: DataFrame, path: str, receipts: str, keys: list[str], order: list[str]) -> bool:
    """Upserts a batch unless its receipt is there (S23, T02); whether it was new."""
    spark, name = rows.sparkSession, digest(rows)
    known = current(spark, receipts)
    if known is not None and not known.where(F.col("digest") == name).isEmpty():
        return False
    upsert(rows, path, keys, order)
    receipt = spark.range(1).select(F.lit(name).alias("digest"), F.current_timestamp().alias("at"))
    _put(receipt if known is None else known.unionByName(receipt), receipts)
    return True


def kept_snapshots(rows: DataFrame, keys: list[str], at: str, watched: list[str], hours: float) -> DataFrame:
    """The rows that a throttle keeps: the first of a key, a change of a watched value against the last kept one, or so many hours
    since it (W03, W04). What is kept depends on what was kept before, which no window can say: partitions are sorted by key and
    time and passed once, with the last kept row as the only state, so neither the number of keys nor a key's rows matter.
    """
    step = int(hours * 3_600_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, then = None, None, 0
        for batch in batches:
            column = lambda c: batch.column(c).to_pylist()
            times = batch.column(at).cast(pa.timestamp("us", batch.schema.field(at).type.tz)).cast(pa.int64()).to_pylist()
            keep = []
            for k, t, v in zip(zip(*map(column, keys)), times, zip(*map(column, watched))):
                keep.append(k != key or v != last or (t is not None and then is not None and t - then >= step))
                if keep[-1]:
                    key, last, then = k, v, t
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, at, *watched).mapInArrow(run, rows.schema)


def changes(before: DataFrame, after: DataFrame, keys: list[str], watched: list[str]) -> DataFrame:
    """keys, change: new, gone, changed or same, from two states of a table."""
    value = lambda d, n: d.select(*keys, F.xxhash64(*watched).alias(n))
    both = value(before, "_b").join(value(after, "_a"), keys, "full")
    kind = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return both.select(*keys, kind.alias("change"))
