"""The trend score by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketlens.operators.trend import trend_scores

NOW = datetime(2024, 6, 30)
back = lambda d: NOW - timedelta(days=d)


def run(spark, listings, signals=(), prices=(), confirmed=()):
    tables = (
        (listings, "product_id long, listing_id long, source string, country string, observed_at timestamp"), (signals, "product_id long, listing_id long, kind string, value double, captured_at timestamp"),
        (prices, "product_id long, listing_id long, value double, captured_at timestamp, currency string"), (confirmed, "product_id long, n long"),
    )
    rows = trend_scores(*(spark.createDataFrame(list(r), s) for r, s in tables), F.lit(NOW)).collect()
    return {r.product_id: (r, {c["name"]: (c["value"], round(c["score"], 6)) for c in r.components}) for r in rows}


def test_components_missing_and_confidence(spark):
    listings = [(1, 1, "bol", "NL", back(40)), (1, 2, "etsy", "DE", back(3)), (2, 3, "bol", "NL", back(2))]
    signals = [
        (1, 1, "search_rank", 10.0, back(20)), (1, 1, "search_rank", 4.0, back(1)), (1, 1, "search_rank", 90.0, back(31)),  # before the window
        (1, 2, "rating_count", 5.0, back(9)), (1, 2, "rating_count", 30.0, back(8)), (1, 2, "views", 900.0, back(9)), (1, 2, "views", 400.0, back(2)), (1, 2, "favorites", 3.0, back(2)),
    ]
    prices = [(1, 1, 10.0, back(9), "EUR"), (1, 1, 9.0, back(2), "EUR"), (1, 2, 10.0, back(9), "EUR"), (1, 2, 30.0, back(2), "USD"), (1, 1, 9.5, back(5), "EUR")]
    got = run(spark, listings, signals, prices, [(1, 2)])
    row, parts = got[1]
    want = {
        "new_listings_7d": (1, 0.2), "source_presence": (2, 0.5), "country_presence": (2, 0.333333), "search_rank_change": (6.0, 0.8), "rating_count_growth": (25, 0.5), "price_change_pct": (-10.0, 0.5),
        "confirmed_ad_matches": (2, 0.666667), "etsy_views_growth": (-500, 0.0),
    }
    assert parts == want and abs(row.score - 43.75) < 0.0501 and (row.missing, row.history_days, row.insufficient_data, row.confidence) == ([], 40, False, "high")
    row, parts = got[2]
    assert row.missing == ["search_rank_change", "rating_count_growth", "price_change_pct"] and row.insufficient_data and row.confidence == "low" and len(parts) == 4 and row.score == round(100 * 0.2 / 4, 1)


def test_no_listing_no_row(spark):
    assert run(spark, [], [(1, 1, "views", 1.0, NOW)]) == {}
