"""Pairs by token set and by identity keys against brute force."""

import itertools

from marketlens import registry

SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def pairs(spark, folder, name):
    return sorted((r.a, r.b) for r in registry.QUERIES[name](spark, str(folder)).collect())


def test_token_sets_and_identity_groups(spark, tmp_path):
    names = ["Red Ünit-Case", "case red ünit red", "red case", "red", "Red!", None, "a  b", *["b a x"] * 7]
    rows = [(i, n, "s" if i < 5 else "m", "t", 1) for i, n in enumerate(names)] + [(i, f"only {i}", "l", "t", 2) for i in range(100, 141)] + [(200, "no brand", None, "t", 1), (201, "brandless", None, "t", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "part.parquet"))
    assert pairs(spark, tmp_path, "j09_token_set_pairs") == [(0, 1)]
    small = [*itertools.combinations(range(5), 2), *itertools.combinations(range(5, len(names)), 2)]
    assert pairs(spark, tmp_path, "j10_identity_star") == sorted([*small, *((100, i) for i in range(101, 141))])
