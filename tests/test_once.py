"""Costly values of a text are computed once a row."""

from marketlens import registry
from marketlens.functions import text
from marketlens.operators import applied


def test_patterns_stand_once_in_the_plan(spark, sf):
    for name, mark in (("f40_compliance_risk", "rolex"), ("f10_language_by_shares", "([\\p{L}\\p{M}']+)")):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(mark) == 1, (name, plan.count(mark))


def test_null_and_short_texts(spark):
    df = spark.createDataFrame([(0, None), (1, "ein Wort"), (2, "der Hund und die Katze"), (3, "สวัสดีชาวโลก"), (4, "qqq www eee")], "i long, t string")
    got = {r[0]: r[1] for r in df.select("i", text.detected_language("t", applied.SCRIPTS, applied.WORDS, applied.MARKS)).collect()}
    assert got == {0: "und", 1: "und", 2: "de", 3: "th", 4: "und"}
