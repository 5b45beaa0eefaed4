"""Sharding: a Feistel permutation with cycle walking over global row numbers gives a reproducible shuffle.

Row i of the order by doc_id goes to place p(i) of a permutation of 0..n-1, so shard = p mod shards and slot = p div shards
can be computed, slots have no gaps and shards differ by a row at most. Only DataFrame functions run.

Defined cases: null keys come first in the order and null texts count as empty; repeated rows each get a place; an
empty table gives an empty result. The order depends on the rows alone, not on files, partitions or the cluster.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import text_of, written

ROUNDS, WALK = 6, 40


def feistel(x: Column, n: int, seed: int) -> Column:
    """Where a keyed permutation of 0..n-1 takes x.

    The domain is a grid of a by b cells with a = ceil(sqrt n) and a * b < n + a. Rounds add a hash of one coordinate to the
    other; a cell beyond n is walked on along its cycle. A step leaves the range with probability under 1/sqrt n + 1/n, so
    40 steps are not enough with probability below (1/sqrt n)^40; such a row would raise an error.
    """
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))

    def once(v: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            h = lambda part: F.xxhash64(F.lit(seed).cast("long"), i, part)
            even = i % 2 == 0
            return F.struct(
                F.when(even, F.pmod(s["x"] + F.pmod(h(s["y"]), F.lit(a).cast("long")), F.lit(a).cast("long"))).otherwise(s["x"]).alias("x"),
                F.when(even, s["y"]).otherwise(F.pmod(s["y"] + F.pmod(h(s["x"]), F.lit(b).cast("long")), F.lit(b).cast("long"))).alias("y"),
            )

        start = F.struct(F.pmod(v, F.lit(a).cast("long")).alias("x"), F.floor(v / F.lit(a)).cast("long").alias("y"))
        rounds = F.array(*(F.lit(i).cast("long") for i in range(ROUNDS)))
        return F.aggregate(rounds, start, turn, lambda s: s["x"] + s["y"] * F.lit(a).cast("long"))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def row_numbers(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """df, written to the shared folder in the order of its columns `order`, with gapless global row numbers from 0.

    Ranges of the order are numbered by the sums of the counts of the ranges before: a table of one row per partition.
    """
    tie, place = "_tie", "_place"
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *order, tie)
    laid = written(ranged.sortWithinPartitions(*order, tie).drop(tie).withColumn(place, F.monotonically_increasing_id()), "rows")
    part, within = F.shiftrightunsigned(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    counts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.expr("sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("_before"))
    joined = laid.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row per range partition: bounded
    return joined.select(*df.columns, (F.col("_before") + within).alias(name))


def shard_rows(df: DataFrame, order: list[str], shards: int = 40, seed: int = 20240229) -> DataFrame:
    """df (keep it narrow: it is sorted once) with shard and slot; `order` must tell different rows apart."""
    numbered = row_numbers(df, *order, name="_row")
    n = numbered.count()
    p = numbered.withColumn("_p", feistel(F.col("_row"), n, seed))
    return p.select(*df.columns, F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law of equal row counts."""
    narrow = docs.select("doc_id", (F.octet_length(text_of()) + 16).cast("long").alias("size"), F.crc32(text_of()).cast("long").alias("text_crc32"))
    out = shard_rows(narrow, ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
