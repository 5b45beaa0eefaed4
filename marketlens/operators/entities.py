"""Pairs of products: evidence, a noisy-or score, guards, verdicts and groups.

Products: id, name, status, category, price, n_ads, manual, and what they are keyed by. Candidate pairs come from shared keys,
never from all pairs; a key of many products gives a star around the least one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import compare, text

#: Weight of each kind of evidence (fixed values of the score).
WEIGHTS = {"landing": 0.85, "copy": 0.80, "phash": 0.60, "identity": 0.96}
AUTO, REVIEW, FAN = 0.93, 0.60, 40


def key_pairs(rows: DataFrame, key: str, kind: str, fan: int = FAN) -> DataFrame:
    """rows (id, key) -> a, b, kind: all pairs in groups of up to `fan`, a star around the least id in larger ones."""
    g = rows.where(F.col(key).isNotNull()).select("id", key).distinct()
    sizes = g.groupBy(key).agg(F.count("*").alias("fan"), F.min("id").alias("head")).where("fan > 1")
    g = g.join(sizes, key)
    small = g.where(F.col("fan") <= fan).select(key, F.col("id").alias("a")).join(g.select(key, F.col("id").alias("b")), key).where("a < b")
    star = g.where((F.col("fan") > fan) & (F.col("id") > F.col("head"))).select(F.col("head").alias("a"), F.col("id").alias("b"))
    return small.select("a", "b").union(star).distinct().withColumn("kind", F.lit(kind))


def evidence(pairs: DataFrame) -> DataFrame:
    """a, b, kinds: one row for each pair with the kinds of evidence for it."""
    return pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def name_weight(similarity: Column, sure: Column) -> Column:
    return F.when(similarity >= 0.8, F.when(sure, 0.75).otherwise(0.60)).when(similarity >= 0.6, 0.45).otherwise(0.0)


def noisy_or(weights: list[Column]) -> Column:
    """1 minus the product of what each piece of evidence leaves open."""
    rest = F.lit(1.0)
    for w in weights:
        rest = rest * (1 - w)
    return F.round(1 - rest, 3)


def scored(pairs: DataFrame, products: DataFrame, rejected: DataFrame | None = None, similarity: Column | None = None, most_ads: int = 60) -> DataFrame:
    """Pairs with evidence -> score, blockers, relation, verdict.

    similarity: a Column over names tokens_a and tokens_b; the title similarity where it is not given.
    """
    side = lambda s: products.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "name", "status", "category", "price", "n_ads", "manual"))).withColumn(f"tokens_{s}", text.name_tokens(f"name_{s}"))
    rows = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    if rejected is not None:
        rows = rows.join(rejected.select("a", "b").distinct().withColumn("cannot", F.lit(True)), ["a", "b"], "left")
    else:
        rows = rows.withColumn("cannot", F.lit(None).cast("boolean"))
    rows = rows.withColumn("similarity", similarity if similarity is not None else compare.title_similarity(F.col("tokens_a"), F.col("tokens_b")))
    sure = (F.col("status_a") == "CONFIRMED") & (F.col("status_b") == "CONFIRMED")
    has = lambda k: F.array_contains("kinds", k)
    score = noisy_or([*(F.when(has(k), w).otherwise(0.0) for k, w in WEIGHTS.items()), name_weight(F.col("similarity"), sure)])
    named = (F.col("status_a") != "UNKNOWN") & (F.col("status_b") != "UNKNOWN")
    low = named & (F.col("similarity") < 0.3)
    models = [compare.numeric_models(F.col(f"name_{s}")) for s in "ab"]
    differ = named & (F.size(models[0]) > 0) & (F.size(models[1]) > 0) & (F.array_sort(models[0]) != F.array_sort(models[1]))
    both_manual = F.col("manual_a") & F.col("manual_b")
    hard = {"cannot_link": F.col("cannot").isNotNull(), "verified_names_differ": low & both_manual, "model_number_conflict": differ}
    soft = {
        "name_conflict": low & ~both_manual,
        "category_conflict": F.col("category_a") != F.col("category_b"),
        "price_gap": F.greatest("price_a", "price_b") > 3 * F.least("price_a", "price_b"),
        "big_cluster": (F.col("n_ads_a") + F.col("n_ads_b") > most_ads) & ~(named & (F.col("similarity") >= 0.8)),
    }
    blockers = lambda rules: F.filter(F.array(*(F.when(c, k) for k, c in rules.items())), lambda x: x.isNotNull())
    rows = rows.select("a", "b", "kinds", F.col("similarity"), score.alias("score"), blockers(hard).alias("hard"), blockers(soft).alias("soft")).where(F.col("score") >= REVIEW)
    same = has("identity") | has("landing") | has("copy") | (has("phash") & (F.col("similarity") >= 0.6))
    relation = F.when(F.size("hard") > 0, "different_product").when(same, "duplicate_product").otherwise("similar_product")
    verdict = F.when(F.size("hard") > 0, "blocked").when(~same, "similar").when((F.col("score") >= AUTO) & (F.size("soft") == 0), "auto").otherwise("pending")
    return rows.select("a", "b", "kinds", F.round("similarity", 6).alias("similarity"), "score", F.concat("hard", "soft").alias("blockers"), relation.alias("relation"), verdict.alias("verdict"))


def merge_targets(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """a, b -> source, target: the pair's sources point to the product of higher rank, by name status, manual care, ads, and lesser id."""
    rank = lambda s: F.struct(F.when(F.col(f"{s}.status") == "CONFIRMED", 2).when(F.col(f"{s}.status") == "UNKNOWN", 0).otherwise(1).alias("r"), F.col(f"{s}.manual").alias("m"), F.col(f"{s}.n_ads").alias("n"), (-F.col(f"{s}.id")).alias("i"))
    rows = pairs.join(products.alias("x"), F.col("a") == F.col("x.id")).join(products.alias("y"), F.col("b") == F.col("y.id"))
    first = rank("x") > rank("y")
    return rows.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("target"))


def merged_roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """source -> root: every product's last target, by pointer jumping, each round a checkpoint where the session has a folder.

    Cycles have no root: a link back to a source already passed is found as a pointer that no round shortens, and raises (J24).
    """
    spark = links.sparkSession
    keep = (lambda d: d.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda d: d)
    p = keep(links.groupBy("source").agg(F.min("target").alias("root")))
    for _ in range(rounds):
        up = p.select(F.col("source").alias("root"), F.col("root").alias("further"))
        if p.join(up, "root", "left_semi").isEmpty():
            return p
        p = keep(p.join(up, "root", "left").select("source", F.coalesce("further", "root").alias("root")))
    raise ValueError("the links hold a cycle, or a chain beyond 2^rounds")
