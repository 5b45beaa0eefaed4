"""Scores of hand-made rows, worked out by hand from the published weights."""

import pytest

from marketlens.dialect import spell
from marketlens.plans.views import SCORES

COLUMNS = "product_id total_ads active_ads unique_ads new_ads prev_ads removed_ads running_30d strong_ads longevity_days force_top stores sources engagement_per_ad variants advertisers new_advertisers advertiser_hhi markets acceleration growth advertiser_growth duplication avg_price data_days".split()


@pytest.fixture(scope="module")
def scored(spark):
    text = spell(SCORES, 0)
    text = "WITH " + text[text.index("parts AS (") :] + " SELECT * FROM scored"
    rows = [
        # one old ad of one seller: proves nothing
        (1, 1, 1, 1, 0, 0, 0, 1, 0, 120, 40.0, 0, 1, 0.0, 1, 1, 0, 1.0, 1, 0, 0.0, 0.0, 0.0, 20.0, 120),
        # two growing sellers in four markets
        (2, 80, 10, 10, 5, 0, 0, 0, 5, 120, 70.0, 0, 3, 400.0, 5, 15, 3, 0.15, 4, 5, 1.2, 0.8, 0.0, 20.0, 60),
        # nothing live
        (3, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0.0, 4, 1, 0.0, 1, 4, 0, 1.0, 1, 0, 0.0, 0.0, 0.0, 80.0, 60),
    ]
    kinds = ["double" if c in ("force_top", "engagement_per_ad", "advertiser_hhi", "growth", "advertiser_growth", "duplication", "avg_price") else "long" for c in COLUMNS]
    spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds))).createOrReplaceTempView("feature")
    yield {r.product_id: r for r in spark.sql(text).collect()}
    spark.catalog.dropTempView("feature")


def test_one_old_ad(scored):
    r = scored[1]
    assert r.demand == pytest.approx(35.0)  # the longest run alone: .35 * 100; one seller gives 0, one market 0
    assert r.momentum == 0 and r.saturation == pytest.approx(0.25 * 15 / 0.8) and r.saturation_state == "Low Saturation"
    assert r.rarity == pytest.approx(100) and r.velocity == 0 and r.margin == 75
    assert r.confidence == pytest.approx(0.20 * 100 / 0.85) and (r.quadrant, r.decision) == ("LOW_SIGNAL", "SKIP") and r.opportunity <= 30
    win = (0.15 * (0.4 * (40 - 15) / 55 * 100 + 0.3 * 100 + 0.3 * 5)) / 0.80
    assert r.win == pytest.approx(win)


def test_growing_product(scored):
    r = scored[2]
    assert r.demand == pytest.approx(35 + 30 + 0.2 * 70 + 15) and r.momentum == pytest.approx(100) and r.velocity == pytest.approx(100)
    assert r.saturation == pytest.approx((0.25 * 50 + 0.15 * 80) / 0.8) and r.saturation_state == "Growing"
    assert r.confidence == pytest.approx(100) and (r.quadrant, r.decision) == ("BREAKOUT", "TEST_NOW")
    novelty = (0.20 * 100 + 0.15 * 40) / 0.85
    raw = 0.28 * 94 + 14 + 6 + 5 + 0.08 * novelty + 2.4 + 2.4 + 0.12 * 75 - 0.12 * (r.saturation - 30)
    assert r.opportunity == pytest.approx(raw)


def test_nothing_live(scored):
    r = scored[3]
    assert r.decision == "SKIP" and r.rarity == pytest.approx(25 * 100 / 80) and r.margin == 60
