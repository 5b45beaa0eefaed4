"""Partitions grow with the rows, so that the memory of a task doesn't."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marketlens import registry
from marketlens.operators import ingest
from marketlens.sources import store


@pytest.mark.parametrize("name", ["w06_consecutive_rises", "j20_as_of_join"])
def test_offers_are_dealt_in_partitions_of_bounded_size(spark, sf, monkeypatch, name):
    monkeypatch.setattr(store, "PARTITION_ROWS", 500)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    df = registry.QUERIES[name](spark, sf)
    assert f"hashpartitioning(l_partkey#" in (plan := df._jdf.queryExecution().executedPlan().toString())
    assert [x.split(", ")[2].split(")")[0] for x in plan.split("Exchange hashpartitioning(l_partkey#")[1:]].count(str(n)) >= 1 and n > 4
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS FROM '{sf}/lineitem.parquet'")
    want = sorted(map(str, c.execute(registry.ORACLES[name]).fetchall()))
    assert len(want) == df.count()
    if name == "w06_consecutive_rises":
        assert want == sorted(str(tuple(r)) for r in df.collect())


def test_entities_without_a_key_are_dealt_apart(spark):
    e = spark.createDataFrame([(str(i), "s", i, str(i), "k" if i < 2 else None) for i in range(400)], "entity string, source string, since long, head string, key string")
    out = ingest._starred(e.repartition(4), F.col("key"))
    assert {r.entity: r.head for r in out.collect()} == {str(i): "0" if i < 2 else str(i) for i in range(400)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [r.n for r in ingest._starred(e.repartition(4), F.col("key")).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(rows) == 400 and max(rows) < 200
