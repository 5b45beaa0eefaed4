"""Joins by classes against SQL over all pairs, on repeated ids, nulls, large classes and classes cut into parts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marketlens import registry
from marketlens.dialect import Operator, spell
from marketlens.operators import classes

NAMES = ["large ring", "red ring", "ring", "red hot bolt", "hot bolt red", "", " ", "Bolt  bolt", "blue gear", None, "old large ring"]
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
BUILT = {o.name: o for o in registry.OPERATORS if isinstance(o, Operator) and o.build}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng, path = random.Random(3), tmp_path_factory.mktemp("odd")
    part = [(i, rng.choice(NAMES), rng.choice(["A", "B", None]), rng.choice(["S", "T"]), 1, 1.0) for i in range(160)]
    part += [(7, "large ring", "A", "S", 1, 1.0), (20, "red ring", "A", "T", 1, 1.0), (20, "red ring", "A", "T", 1, 1.0), (None, "ring", "A", "S", 1, 1.0)]
    spark.createDataFrame(part, PART).write.parquet(str(path / "part.parquet"))
    events = [(i if i > 4 else 1, rng.choice([1, 2, 3, 4, None]), rng.choice(["click", "purchase", "view"]), f'{{"k": {rng.randrange(5)}}}', 1.0) for i in range(90)]
    events = spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string, value double")
    events.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(str(path / "events.parquet"))
    con = duckdb.connect()
    for t in ("part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    return str(path), con


def rows(got, columns):
    return sorted((tuple(r[c] for c in columns) for r in got), key=str)


@pytest.mark.parametrize("cell", [3, 2048])
@pytest.mark.parametrize("name", ["j12_hamming_join", "j14_best_match", "j16_blocked_jaccard", "t07_fan_out", "j24_parent_roots"])
def test_as_all_pairs(spark, odd, name, cell, monkeypatch):
    monkeypatch.setattr(classes, "CELL", cell)
    path, con = odd
    rel = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in rel.description]
    want = sorted(rel.fetchall(), key=str)
    got = rows(registry.QUERIES[name](spark, path).collect(), columns)
    assert len(want) > 20 and got == want


def test_lists_by_tier(spark, odd):
    """Repeated ids leave ties, so scores are compared row by row and the ids of ids that stand once."""
    path, con = odd
    rel = con.execute(registry.ORACLES["o07_tiered_similarity"])
    columns = [c[0] for c in rel.description]
    got, want = rows(registry.QUERIES["o07_tiered_similarity"](spark, path).collect(), columns), sorted(rel.fetchall(), key=str)
    assert len(want) > 20 and got == want


@pytest.mark.parametrize("name", sorted(BUILT))
def test_columns_and_types_of_the_sql(spark, sf, name):
    o = BUILT[name]
    plain = type(o)(o.name, o.sql, o.check)
    if name == "j24_parent_roots":
        assert o.spark(spark, sf).columns == ["id", "root"]
        return
    assert [(f.name, f.dataType) for f in o.spark(spark, sf).schema] == [(f.name, f.dataType) for f in plain.spark(spark, sf).schema]
    assert spell(o.check or o.sql, 1) == o.other()


def test_long_chains_and_many_rows(spark, tmp_path):
    """The recursive query ends with an error beyond the session's number of rows; ways that double have no such end."""
    key, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.range(1, 3000).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    spark.conf.set(key, "1000")
    try:
        got = {r.id: r.root for r in registry.QUERIES["j24_parent_roots"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(key, before)
    root = lambda n: root(n // 3) if n % 3 == 0 else n
    assert got == {n: root(n) for n in range(1, 3000)}
    chain = spark.range(500).select("id", F.greatest(F.col("id") - 1, F.lit(0)).alias("parent"))
    assert {r.root for r in classes.least_ancestors(chain).collect()} == {0} and classes.least_ancestors(chain).count() == 500


@pytest.mark.parametrize("name", ["j14_best_match", "o07_tiered_similarity"])
def test_one_large_class_makes_no_pairs(spark, tmp_path, name):
    """20,000 products of one name, brand and type: 400 million pairs if all met."""
    spark.range(20_000).selectExpr("id AS p_partkey", "'red ring' AS p_name", "'A' AS p_brand", "'S' AS p_type", "1 AS p_size", "1D AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    got = df.collect()
    assert len(got) == (20_000 if name == "j14_best_match" else 5_000)
    metrics = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in metrics and "NestedLoop" not in metrics
