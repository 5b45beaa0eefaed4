"""Functions on hand-made rows: prices in texts, identities, pair scores, merges, language, risks."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions import compare, money, rules, text
from marketlens.operators import applied, entities, search


@pytest.mark.parametrize("copy, country, want", [
    ("now ₱1,299.00 only", "PH", (1299.0, "PHP")), ("199 SAR today", None, (199.0, "SAR")), ("was $19.99", None, (19.99, "USD")), ("199.000đ", None, (199000.0, "VND")),
    ("giá 199k thôi", None, (199000.0, "VND")), ("99k followers", "US", None), ("4K video giá", "VN", None), ("50k lượt mua", "VN", None), ("chỉ 2 triệu", "VN", (2000000.0, "VND")),
    ("15 triệu chai đã bán", "VN", None), ("P499", "US", None), ("P499", "PH", (499.0, "PHP")), ("Freeship 0đ", "VN", None), ("no price", None, None), (None, None, None), ("abc$5x", None, None),
])
def test_prices_in_texts(spark, copy, country, want):
    r = spark.createDataFrame([(copy, country)], "t string, c string").select(money.parsed_price(F.col("t"), F.col("c")).alias("p")).first().p
    assert (r and tuple(r)) == want


def test_identities_and_titles(spark):
    rows = [("4006381333931", "a", None, "x", "4006381333931", "A ", None, "y"), ("", "a", "m1", "", "", "a", "m2", ""), (None, "a", None, "S1", None, "a", None, "s1"), (None, None, None, "s", None, None, None, "s")]
    df = spark.createDataFrame(rows, "g1 string, b1 string, m1 string, s1 string, g2 string, b2 string, m2 string, s2 string")
    side = lambda i: {k: F.col(f"{k[0]}{i}") for k in ("gtin", "brand", "model", "sku")}
    assert [r[0] for r in df.select(compare.identity_match(side(1), side(2))).collect()] == [True, False, True, None]
    t = spark.createDataFrame([("iPhone 15 case", "case for iphone 15 128gb"), ("iPhone 15 case", "iphone 16 case"), ("case", "x 9")], "a string, b string")
    assert [r[0] for r in t.select(compare.compatible_titles(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    ean = spark.createDataFrame([("4006381333931",), ("4006381333932",), ("00000000",), ("96385074",), (None,)], "g string")
    assert [r[0] for r in ean.select(compare.valid_gtin(F.col("g"))).collect()] == [True, False, False, True, None]
    s = spark.createDataFrame([(["neck", "massager"], ["massager", "neck"]), (["a1", "b1", "c1"], ["a1", "x1", "y1", "z1"]), ([], ["a"])], "a array<string>, b array<string>")
    got = [r[0] for r in s.select(compare.title_similarity(F.col("a"), F.col("b"))).collect()]
    from difflib import SequenceMatcher

    assert got[0] == pytest.approx(0.4 + 0.35 * 0.5 + 0.25) and got[1] == pytest.approx(0.4 / 6 + 0.35 / 3 + 0.25 * SequenceMatcher(None, "a1 b1 c1", "a1 x1 y1 z1").ratio()) and got[2] == 0


def test_language_and_risks(spark):
    rows = [("the cat and the dog", "en"), ("привет мир как дела", "ru"), ("der Hund und die Katze", "de"), ("ok", "und"), ("xx yy zz", "und"), ("đắt lắm ạ được", "vi"), (None, "und")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r[0] for r in df.select(text.detected_language("t", applied.SCRIPTS, applied.WORDS, applied.MARKS)).collect()] == [w for _, w in rows]
    risky = spark.createDataFrame([("cheap gucci bag",), ("massage gun for you",), ("air gun replica",), ("semi-cured gel",), (None,)], "t string")
    assert [(r.r.risk, r.r.flags) for r in risky.select(rules.compliance_risk(F.col("t")).alias("r")).collect()] == [(45, ["brand", "cheap_luxury"]), (0, []), (85, ["counterfeit", "restricted"]), (0, []), (0, [])]


def test_pair_scores_guards_and_merges(spark):
    p = spark.createDataFrame([
        (1, "neck massager blue", "CONFIRMED", "c", 10.0, 3, False), (2, "blue neck massager", "CONFIRMED", "c", 12.0, 2, False), (3, "hair dryer", "SUGGESTED", "c", 10.0, 1, True),
        (4, "lamp 15", "CONFIRMED", "c", 50.0, 1, False), (5, "lamp 16", "CONFIRMED", "c", 10.0, 1, False)], "id long, name string, status string, category string, price double, n_ads long, manual boolean")
    pairs = spark.createDataFrame([(1, 2, ["copy", "landing"]), (1, 3, ["identity"]), (4, 5, ["landing"]), (2, 3, ["phash"])], "a long, b long, kinds array<string>")
    got = {(r.a, r.b): r for r in entities.scored(pairs, p, rejected=spark.createDataFrame([(2, 3)], "a long, b long")).collect()}
    assert got[1, 2].score == pytest.approx(1 - 0.15 * 0.2 * 0.25, abs=1e-3) and got[1, 2].verdict == "auto" and got[1, 2].relation == "duplicate_product"
    assert got[1, 3].verdict == "pending" and got[1, 3].blockers == ["name_conflict"]
    assert got[4, 5].verdict == "blocked" and set(got[4, 5].blockers) >= {"model_number_conflict", "price_gap"}
    assert got[2, 3].verdict == "blocked" and "cannot_link" in got[2, 3].blockers
    target = entities.merge_targets(pairs.where("a = 1 AND b = 3").select("a", "b"), p).first()
    assert (target.source, target.target) == (3, 1)
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "source long, target long")
    assert {r.root for r in entities.merged_roots(chain).collect()} == {20}
    with pytest.raises(ValueError):
        entities.merged_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source long, target long"), rounds=6)
    star = entities.key_pairs(spark.range(100).select("id", F.lit("k").alias("key")), "key", "x")
    assert star.count() == 99 and entities.key_pairs(spark.range(5).select("id", F.lit("k").alias("key")), "key", "x").count() == 10


def test_search_tiers_and_limits(spark):
    rows = spark.createDataFrame([(1, "neck massager"), (2, "shoulder device"), (3, "pillow"), (4, "neck massager fake"), (5, "bottleneck massager"), (6, None)], "id long, t string")
    hits = search.search(rows, "t", ["neck massager"], synonyms={"neck massager": [["shoulder"]]}, related={"neck massager": ["pillow"]}, exclude=["fake"])
    assert {(r.id, r.tier, r.n_strong) for r in hits.collect()} == {(1, 0, 1), (2, 1, 1), (3, 2, 0)}
    assert {r.id for r in search.search(rows, "t", ["neck massager"], related={"neck massager": ["pillow"]}, enough=1).collect()} == {1, 4}
    assert [r.id for r in search.page(hits, search.by_relevance(hits, [F.asc("id")]), 1, 1).collect()] == [2]


def test_short_terms_begin_words(spark):
    rows = spark.createDataFrame([(1, "(the lamp"), (2, "a\nthe end"), (3, "breathe"), (4, "The"), (5, "\u00e9the"), (6, "x-the"), (7, "_the")], "id long, t string")
    assert sorted(r.id for r in search.search(rows, "t", ["the"]).collect()) == [1, 2, 4, 6]
