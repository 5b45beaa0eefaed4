"""Doubles are rounded by their binary value, as in the SQL of the checks."""

import duckdb
from pyspark.sql import functions as F

from marketlens import registry
from marketlens.dialect import binary_rounds
from marketlens.functions.rounding import rounded

VALUES = [64.0746875, 526.4484375, 0.285, 1.005, 39.55, -1.005, 2.675, 0.5, 1e-9, None, 265.4315625]


def test_halves_as_duckdb(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i long, v double")
    got = {r.i: (r.a, r.b, r.c) for r in df.select("i", rounded("v", 6).alias("a"), rounded("v", 2).alias("b"), F.expr(binary_rounds("round(v, 1)")).alias("c")).collect()}
    want = {i: duckdb.execute("SELECT round(?::DOUBLE, 6), round(?::DOUBLE, 2), round(?::DOUBLE, 1)", [v, v, v]).fetchone() for i, v in enumerate(VALUES)}
    assert got == want


def test_nested_rounds():
    assert binary_rounds("round(round(a, 1) + b, 2), round(c)") == "(round(CAST((round(CAST(a AS DOUBLE) * 10D, 0) / 10D) + b AS DOUBLE) * 100D, 0) / 100D), round(c)"


def test_prices_of_top_k_as_duckdb(spark, tmp_path):
    """Price 6407.46875 / 100: an exact half at the seventh digit as text, less than it as a double."""
    spark.createDataFrame([(1,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    rows = [(1, s, 1, 1, p, float(q), 0.0) for s, (p, q) in enumerate([(2050.39, 32.0), (26946.12, 48.0), (1153.34, 18.0), (64.0746875, 1.0)])]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double").withColumn("l_shipdate", F.lit("2000-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES["j07_lateral_top_k"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(registry.ORACLES["j07_lateral_top_k"]).fetchall()) and len(got) == 2
