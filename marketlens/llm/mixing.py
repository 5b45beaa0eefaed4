"""Mixing sources to target weights: nested hash thresholds from histograms, without sorting.

Each document has a fixed 60-bit hash. Tokens are summed by source and the hash's next 12 bits; the bucket in which the
running sum crosses the budget is split by the next 12 bits, and so on, until one hash value is left. A document is in when
its hash is below the threshold, so a larger budget takes a superset. Only DataFrame functions run.

Defined cases: null sources are one source, the last; a null text has size 0; rows that share a doc_id share their hash and
go in or out together; sources without words have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import fresh, n_words, written

#: Weights of the sources in the order of their code points, repeating, and the most epochs of a source: fixed by the contract.
WEIGHTS, MOST = (5, 2, 1), 3
BITS, LEVELS, SEED = 12, 5, "mix-1"


def hash60(key: str, seed: str = SEED) -> Column:
    """60 bits of an MD5 of the key, as other engines can compute them too."""
    value = F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> also target, which stops at three times the size; the excess is reshared by weight.

    That is a water level: target = min(3 * size, level * weight), with the level at which all targets add up. One row per
    source is ranked, so this one-partition window holds aggregates, not documents.
    """
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1)
    t = sources.withColumn("w", w).withColumn("cap", MOST * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = rest / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", F.when(level <= F.col("cap") / F.col("w"), level)).withColumn("rank", F.row_number().over(by))
    first = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("rank"))).over(Window.partitionBy())
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), first * F.col("w")).alias("target"))


def thresholds(rows: DataFrame) -> DataFrame:
    """source, source_size, target, epochs, threshold: from rows (source, size, hash), read once per level.

    A document is taken `epochs` times, and once more if its hash is at or below the threshold.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(sources).withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long"))
    edge = written(t.select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix")), "budgets")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        known = edge.withColumnRenamed("source", "edge_source")
        inside = rows.join(known, F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("tokens"), F.first("left").alias("left"))
        run = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        crossing = run.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("tokens") <= F.col("left")))
        step = crossing.select(F.col("source").alias("s"), "bucket", "tokens", (F.col("left") - (F.col("upto") - F.col("tokens"))).alias("remains"))
        joined = edge.drop("tokens").join(step, F.col("source").eqNullSafe(F.col("s")), "left")
        keep = ["source", "source_size", "target", "epochs"]
        edge = written(joined.select(*keep, F.col("remains").alias("left"), F.col("bucket").alias("prefix"), "tokens"), "edges")
    nearer = F.col("tokens") - F.col("left") < F.col("left")  # the document on the edge goes in if that comes nearer the target
    return written(edge.select(*keep, F.coalesce(F.col("prefix") - F.when(nearer, 0).otherwise(1), F.lit(-1)).alias("threshold")), "thresholds")


def copies() -> Column:
    return F.least(F.col("epochs") + (F.col("hash") <= F.col("threshold")).cast("long"), F.lit(MOST).cast("long"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    rows = written(docs.select("doc_id", "source", n_words().alias("size"), hash60("doc_id").alias("hash")), "sizes")
    marks = thresholds(rows.select("source", "size", "hash")).withColumnRenamed("source", "s")
    out = rows.join(marks, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them, with the columns of docs.

    The text is neither shuffled nor sorted: the table of thresholds, one row per source, joins to it.
    """
    columns = docs.columns
    names = {c: fresh(f"_mix_{c}", columns) for c in ("s", "source_size", "target", "epochs", "threshold")}
    rows = written(docs.select("source", n_words().alias("size"), hash60("doc_id").alias("hash")), "sizes")
    marks = thresholds(rows).withColumnRenamed("source", "s").withColumnsRenamed(names)
    times = F.least(F.col(names["epochs"]) + (hash60("doc_id") <= F.col(names["threshold"])).cast("long"), F.lit(MOST).cast("long"))
    out = docs.join(marks, F.col("source").eqNullSafe(F.col(names["s"])))
    copy = fresh("_mix_copy", columns)
    return out.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*columns)
