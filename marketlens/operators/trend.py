"""Trend of a product from what was observed of its listings (X24): the mean of the components that have data, with those that lack it.

Everything is an aggregation by listing and kind, then by product, so the sizes that meet in one row are counts and sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.dialect import Query
from marketlens.functions.rounding import rounded

#: What a component's value is divided by, and the kinds of signals that are only listed where they exist.
GROWTHS = {"favorites": ("etsy_favorites_growth", 50), "views": ("etsy_views_growth", 2000), "offer_count": ("offer_count_change", 5)}
NEEDED = ("search_rank_change", "rating_count_growth", "price_change_pct")


def _moves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last: the first and the last value by captured_at of keys with two rows or more."""
    at = F.struct("captured_at", "value")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last")).where("n > 1").drop("n")


def _between(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def trend_scores(listings: DataFrame, signals: DataFrame, prices: DataFrame, confirmed: DataFrame, now: Column, window_days: int = 30) -> DataFrame:
    """product_id, score, components (name, value, score), missing, history_days, insufficient_data, confidence.

    listings (product_id, listing_id, source, country, observed_at), signals (product_id, listing_id, kind, value, captured_at),
    prices (product_id, listing_id, value, captured_at, currency or not), confirmed (product_id, n). A component without data is missing, not zero.
    """
    days = lambda n: now - F.make_dt_interval(F.lit(n))
    base = listings.groupBy("product_id").agg(
        F.count("*").alias("n_listings"), F.count_if(F.col("observed_at") >= days(7)).alias("new"), F.size(F.collect_set("source")).alias("sources"),
        F.size(F.collect_set("country")).alias("countries"), F.min("observed_at").alias("since"),
    )
    recent = signals.where(F.col("captured_at") >= days(window_days))
    moved = _moves(recent, ["product_id", "listing_id", "kind"]).withColumn("by", F.col("last") - F.col("first"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("by"))
    sums = moved.groupBy("product_id").agg(F.avg(-of("search_rank")).alias("rank"), F.sum(of("rating_count")).alias("ratings"), *(F.sum(of(k)).alias(k) for k in GROWTHS))
    seen = recent.groupBy("product_id").agg(F.count("*").alias("n_signals"))
    if "currency" in prices.columns:  # a change has one currency
        one = prices.groupBy("product_id", "listing_id").agg((F.min("currency") == F.max("currency")).alias("one")).where("one").drop("one")
        prices = prices.join(one, ["product_id", "listing_id"])
    change = _moves(prices, ["product_id", "listing_id"]).where("first <> 0").groupBy("product_id").agg(F.avg(rounded((F.col("last") - F.col("first")) / F.col("first") * 100, 1)).alias("change"))
    rows = base.join(sums, "product_id", "left").join(seen, "product_id", "left").join(change, "product_id", "left").join(confirmed.withColumnRenamed("n", "ads"), "product_id", "left").na.fill(0, ["n_signals", "ads"])

    def part(name: str, value: Column, score: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), score.cast("double").alias("score")))

    parts = [
        part("new_listings_7d", F.col("new"), F.least(F.lit(1.0), F.col("new") / 5)), part("source_presence", F.col("sources"), F.least(F.lit(1.0), (F.col("sources") - 1) / 2)),
        part("country_presence", F.col("countries"), F.least(F.lit(1.0), (F.col("countries") - 1) / 3)), part("search_rank_change", rounded("rank", 1), _between(0.5 + F.col("rank") / 20)),
        part("rating_count_growth", F.col("ratings"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("ratings")) / 50)), part("price_change_pct", rounded("change", 1), F.least(F.lit(1.0), F.abs("change") / 20)),
        part("confirmed_ad_matches", F.col("ads"), F.least(F.lit(1.0), F.col("ads") / 3)), *(part(name, F.col(k), _between(F.col(k) / by)) for k, (name, by) in GROWTHS.items()),
    ]
    there = F.filter(F.array(*parts), lambda p: p.isNotNull())
    absent = F.filter(F.array(*(F.when(F.col(c).isNull(), name) for c, name in zip(("rank", "ratings", "change"), NEEDED))), lambda x: x.isNotNull())
    rows = rows.select("product_id", "n_listings", "n_signals", there.alias("components"), absent.alias("missing"), F.datediff(now, "since").alias("history_days"))
    total = F.aggregate("components", F.lit(0.0), lambda s, p: s + p["score"])
    few = (F.col("history_days") < 7) | (F.size("missing") >= 3)
    low = few | (F.col("n_signals") + F.col("n_listings") < 5)
    confidence = F.when(low, "low").when((F.col("history_days") < 30) | (F.size("missing") >= 2), "medium").otherwise("high")
    return rows.select("product_id", rounded(100 * total / F.size("components"), 1).alias("score"), "components", "missing", "history_days", few.alias("insufficient_data"), confidence.alias("confidence"))


def _trends(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a part as its listings, their line items as signals and prices."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 5).alias("listing_id"), "l_suppkey", F.col("l_shipdate").alias("captured_at"), F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        "l_linenumber", F.element_at(F.array(*map(F.lit, ("search_rank", "rating_count", "favorites", "views", "offer_count"))), F.least(F.col("l_linenumber"), F.lit(5))).alias("kind"),
    )
    listings = rows.groupBy("product_id", "listing_id").agg(F.min("captured_at").alias("observed_at"), F.concat(F.lit("s"), F.min("l_suppkey") % 3).alias("source"), (F.min("l_suppkey") % 4).alias("country"))
    confirmed = rows.where("l_linenumber = 7").groupBy("product_id").agg(F.count("*").alias("n"))
    signals = rows.select("product_id", "listing_id", "kind", F.col("q").alias("value"), "captured_at")
    prices = rows.where("l_linenumber < 3").select("product_id", "listing_id", F.round("unit", 0).alias("value"), "captured_at")
    out = trend_scores(listings, signals, prices, confirmed, F.lit("2001-06-30").cast("timestamp"), 1500)
    return out.select("product_id", "score", F.size("components").alias("n_components"), F.array_join("missing", ",").alias("missing"), "history_days", "insufficient_data", "confidence")


_X24 = """
WITH o AS (SELECT l_partkey AS p, l_suppkey % 5 AS l, l_suppkey, l_shipdate AS t, l_quantity AS q, round(l_extendedprice / l_quantity, 0) AS u, l_linenumber AS n,
           ['search_rank', 'rating_count', 'favorites', 'views', 'offer_count'][least(l_linenumber, 5)] AS kind FROM lineitem),
d AS (SELECT TIMESTAMP '2001-06-30' AS now),
b AS (SELECT p, count(*) AS listings, count(*) FILTER (t >= now - INTERVAL 7 DAY) AS fresh, count(DISTINCT s % 3) AS sources, count(DISTINCT s % 4) AS countries, min(t) AS since FROM (SELECT p, l, min(t) AS t, min(l_suppkey) AS s FROM o GROUP BY p, l), d GROUP BY p),
r AS (SELECT o.* FROM o, d WHERE t >= now - INTERVAL 1500 DAY),
f AS (SELECT p, l, kind, last(q ORDER BY t, q) - first(q ORDER BY t, q) AS m FROM r GROUP BY p, l, kind HAVING count(*) > 1),
m AS (SELECT p, avg(-m) FILTER (kind = 'search_rank') AS rank, sum(m) FILTER (kind = 'rating_count') AS ratings, sum(m) FILTER (kind = 'favorites') AS fav, sum(m) FILTER (kind = 'views') AS views, sum(m) FILTER (kind = 'offer_count') AS offers FROM f GROUP BY p),
c AS (SELECT p, avg(round((z - a) / a * 100, 1)) AS change FROM (SELECT p, l, first(u ORDER BY t, u) AS a, last(u ORDER BY t, u) AS z FROM o WHERE n < 3 GROUP BY p, l HAVING count(*) > 1) WHERE a <> 0 GROUP BY p),
k AS (SELECT p, count(*) AS signals FROM r GROUP BY p), a AS (SELECT p, count(*) AS ads FROM o WHERE n = 7 GROUP BY p),
s AS (SELECT b.p, date_diff('day', since, now) AS days, coalesce(signals, 0) + listings AS seen, rank, ratings, change,
      [least(1.0, fresh / 5.0), least(1.0, (sources - 1) / 2.0), least(1.0, (countries - 1) / 3.0), CASE WHEN rank IS NOT NULL THEN greatest(0.0, least(1.0, 0.5 + rank / 20)) END,
       CASE WHEN ratings IS NOT NULL THEN least(1.0, greatest(0.0, ratings) / 50) END, CASE WHEN change IS NOT NULL THEN least(1.0, abs(change) / 20) END, least(1.0, coalesce(ads, 0) / 3.0),
       CASE WHEN fav IS NOT NULL THEN greatest(0.0, least(1.0, fav / 50)) END, CASE WHEN views IS NOT NULL THEN greatest(0.0, least(1.0, views / 2000)) END, CASE WHEN offers IS NOT NULL THEN greatest(0.0, least(1.0, offers / 5)) END]::DOUBLE[] AS x
      FROM b CROSS JOIN d LEFT JOIN m USING (p) LEFT JOIN c USING (p) LEFT JOIN k USING (p) LEFT JOIN a USING (p)),
y AS (SELECT *, list_filter(x, lambda v: v IS NOT NULL) AS parts, (rank IS NULL)::INT + (ratings IS NULL)::INT + (change IS NULL)::INT AS gaps FROM s)
SELECT p AS product_id, round(100 * list_sum(parts) / len(parts), 1) AS score, len(parts)::INT AS n_components,
       concat_ws(',', CASE WHEN rank IS NULL THEN 'search_rank_change' END, CASE WHEN ratings IS NULL THEN 'rating_count_growth' END, CASE WHEN change IS NULL THEN 'price_change_pct' END) AS missing,
       days::INT AS history_days, days < 7 OR gaps >= 3 AS insufficient_data, CASE WHEN days < 7 OR gaps >= 3 OR seen < 5 THEN 'low' WHEN days < 30 OR gaps >= 2 THEN 'medium' ELSE 'high' END AS confidence
FROM y
"""

OPERATORS = [Query("x24_trend_scores", _trends, _X24)]
