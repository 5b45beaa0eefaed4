"""Features, scores and decisions of products, one row each, from one pass over the advertisements."""

from marketlens.dialect import Operator
from marketlens.plans.views import ADS, DAY, FEATURES, SCORES

#: Sorts by what they sort, and tabs with what they admit and sort by.
SORTS = (("opportunity", "opportunity"), ("newest", "-data_days"), ("novelty", "novelty"), ("demand", "demand"), ("ads", "active_ads"), ("growth", "growth"), ("confidence", "confidence"))
TABS = (
    ("breakout", "quadrant = 'BREAKOUT'", "opportunity"), ("experimental", "quadrant = 'EXPERIMENTAL'", "momentum"), ("cash_cow", "quadrant = 'STABLE_WINNER' AND longevity_days >= 60", "demand"),
    ("new", "new_ads > 0 AND prev_ads = 0", "new_ads"), ("scaling", "growth >= 0.3", "growth"), ("risk", "saturation >= 45", "saturation"), ("hidden", "advertisers <= 3 AND demand >= 45", "rarity"), ("novelty", "data_days <= 365", "velocity"),
)


def _listed(entries: tuple) -> str:
    """Each scored product once for every (name, condition, value) that admits it: scores are computed once, not for each list."""
    structs = ", ".join(f"named_struct('name', '{name}', 'ok', {ok}, 's', @dbl({by}))" for name, ok, by in entries)
    return f"e AS (SELECT product_id, explode(filter(array({structs}), x -> x.ok)) AS e FROM scored)"


_R = "round({0}, 4) AS {0}".format
OPERATORS = [
    Operator("a01_product_feature_vector", f"WITH {FEATURES} SELECT product_id, total_ads, active_ads, unique_ads, new_ads, prev_ads, removed_ads, running_30d, longevity_days, advertisers, new_advertisers, {_R('advertiser_hhi')}, markets, acceleration, {_R('growth')}, {_R('duplication')}, {_R('avg_price')}, data_days FROM feature"),
    Operator("a02_channel_features", f"WITH {ADS} SELECT product_id, channel, count(*) AS listings, count(DISTINCT advertiser_id) AS sellers, round(min(price / quantity), 8) AS lowest_price, @sorted_join(market) AS markets FROM ad GROUP BY product_id, channel"),
    Operator("a05_hhi_concentration", f"WITH {FEATURES} SELECT product_id, {_R('advertiser_hhi')} FROM feature"),
    Operator("x01_saturation", f"WITH {SCORES} SELECT product_id, {_R('saturation')}, saturation_state FROM scored"),
    Operator("x03_rarity_velocity", f"WITH {SCORES} SELECT product_id, {_R('rarity')}, {_R('velocity')} FROM scored"),
    Operator("x02_external_win", f"WITH {SCORES} SELECT product_id, {_R('win')}, CASE WHEN win >= 75 THEN 'Likely Winner' WHEN win >= 60 THEN 'Potential Winner' WHEN win >= 45 THEN 'Mixed Signals' ELSE 'Weak Signals' END AS label FROM scored"),
    Operator("x05_margin_potential", f"WITH {SCORES} SELECT product_id, margin FROM scored"),
    Operator("x06_rare_winner", f"WITH {SCORES} SELECT product_id, {_R('rare_winner')} FROM scored"),
    Operator("x07_confidence", f"WITH {SCORES} SELECT product_id, {_R('confidence')}, CASE WHEN confidence >= 70 THEN 'High' WHEN confidence >= 45 THEN 'Medium' ELSE 'Low' END AS label FROM scored"),
    Operator("x08_opportunity_v1", f"WITH {SCORES} SELECT product_id, {_R('opportunity_v1')} FROM scored"),
    Operator("x10_score_bundle", f"WITH {SCORES} SELECT product_id, {_R('win')}, {_R('saturation')}, saturation_state, {_R('rarity')}, {_R('velocity')}, margin, {_R('rare_winner')}, {_R('confidence')}, {_R('novelty')}, {_R('opportunity')} FROM scored"),
    Operator("x16_evidence_row", f"WITH {SCORES} SELECT product_id, active_ads, unique_ads, longevity_days, advertisers, variants, decision FROM scored"),
    Operator("x11_market_demand", f"WITH {SCORES} SELECT product_id, {_R('demand')} FROM scored"),
    Operator("x12_momentum", f"WITH {SCORES} SELECT product_id, {_R('momentum')} FROM scored"),
    Operator("x15_potential_vector", f"WITH {SCORES} SELECT product_id, {_R('demand')}, {_R('momentum')}, {_R('saturation')}, quadrant, {_R('opportunity')} FROM scored"),
    Operator("x17_decision_ladder", f"WITH {SCORES} SELECT decision, quadrant, count(*) AS products, round(avg(opportunity), 4) AS avg_opportunity FROM scored GROUP BY decision, quadrant"),
    Operator("x18_opportunity_cap", f"WITH {SCORES} SELECT decision, round(max(opportunity), 4) AS highest FROM scored GROUP BY decision"),
    Operator("x20_hidden_winner", f"""WITH {SCORES},
        checks AS (SELECT product_id, advertisers BETWEEN 1 AND 3 AS few_sellers, longevity_days >= 7 AS lasting, decision <> 'SKIP' AS wanted, new_ads - prev_ads >= 1 AND @dbl(new_ads - prev_ads) / greatest(1, prev_ads) >= 0.2 OR unique_ads >= 2 AS moving, active_ads, advertisers FROM scored)
        SELECT product_id, few_sellers, lasting, wanted, moving, CASE WHEN few_sellers AND lasting AND wanted AND moving THEN 'CONFIRMED' WHEN NOT wanted OR advertisers > 3 OR active_ads = 0 THEN 'REJECTED' ELSE 'WATCH' END AS verdict FROM checks"""),
    Operator("x23_win_checklist", f"WITH {SCORES} SELECT product_id, CASE WHEN active_ads = 0 THEN 'unknown' WHEN longevity_days >= 30 THEN 'pass' ELSE 'fail' END AS lasting, CASE WHEN advertisers BETWEEN 2 AND 10 THEN 'pass' ELSE 'fail' END AS sellers, CASE WHEN markets >= 2 THEN 'pass' ELSE 'fail' END AS spread, CASE WHEN data_days < 14 THEN 'unknown' WHEN new_ads > prev_ads THEN 'pass' ELSE 'fail' END AS growing FROM scored"),
    Operator("x19_lifecycle", f"""WITH {SCORES},
        s1 AS (SELECT product_id, decision, 'new' AS was, CASE WHEN decision IN ('TEST', 'TEST_NOW') THEN 'testing' WHEN decision = 'WATCH' THEN 'watching' ELSE 'new' END AS step1, demand, active_ads FROM scored)
        SELECT product_id, was, step1, CASE WHEN step1 = 'testing' AND demand >= 70 THEN 'scaling' WHEN step1 = 'watching' AND active_ads = 0 THEN 'retired' ELSE step1 END AS step2 FROM s1"""),
    # the best of each list are cut within partitions before they meet, as the rank has a limit
    Operator("o02_named_sorts", f"""WITH {SCORES}, {_listed(tuple((name, 'true', by) for name, by in SORTS))}, v AS (SELECT e.name AS sort, product_id, round(e.s, 4) AS value FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY sort ORDER BY value DESC, product_id) AS place FROM v) SELECT sort, product_id, value FROM r WHERE place <= 50""",
        check=f"WITH {SCORES} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, product_id, round(@dbl({by}), 4) AS value FROM scored ORDER BY value DESC, product_id LIMIT 50) s_{name}" for name, by in SORTS)),
    Operator("p20_discovery_tabs", f"""WITH {SCORES}, {_listed(TABS)},
        r AS (SELECT e.name AS tab, product_id, round(e.s, 4) AS score, row_number() OVER (PARTITION BY e.name ORDER BY e.s DESC, product_id) AS place FROM e) SELECT * FROM r WHERE place <= 30""",
        check=f"""WITH {SCORES},
        t AS (SELECT 'breakout' AS tab, product_id, opportunity AS s FROM scored WHERE quadrant = 'BREAKOUT' UNION ALL SELECT 'experimental', product_id, momentum FROM scored WHERE quadrant = 'EXPERIMENTAL'
              UNION ALL SELECT 'cash_cow', product_id, demand FROM scored WHERE quadrant = 'STABLE_WINNER' AND longevity_days >= 60 UNION ALL SELECT 'new', product_id, @dbl(new_ads) FROM scored WHERE new_ads > 0 AND prev_ads = 0
              UNION ALL SELECT 'scaling', product_id, growth FROM scored WHERE growth >= 0.3 UNION ALL SELECT 'risk', product_id, saturation FROM scored WHERE saturation >= 45
              UNION ALL SELECT 'hidden', product_id, rarity FROM scored WHERE advertisers <= 3 AND demand >= 45 UNION ALL SELECT 'novelty', product_id, velocity FROM scored WHERE data_days <= 365),
        r AS (SELECT tab, product_id, round(s, 4) AS score, row_number() OVER (PARTITION BY tab ORDER BY s DESC, product_id) AS place FROM t)
        SELECT * FROM r WHERE place <= 30"""),
    Operator("p08_product_list", f"WITH {SCORES} SELECT product_id, p_name AS name, p_type AS category, decision, round(opportunity, 4) AS opportunity FROM scored JOIN part ON p_partkey = product_id WHERE p_size >= 10 AND decision <> 'SKIP' AND confidence >= 20 ORDER BY round(opportunity, 4) DESC NULLS LAST, product_id LIMIT 100"),
    Operator("s21_daily_product_snapshot", f"WITH {SCORES} SELECT {DAY} AS day, product_id, active_ads, advertisers, round(demand, 4) AS demand, decision FROM scored"),
    Operator("a43_section_counts", f"WITH {SCORES} SELECT count(*) AS products, count_if(decision = 'TEST_NOW') AS test_now, count_if(decision = 'TEST') AS test, count_if(decision = 'WATCH') AS watch, count_if(decision = 'SKIP') AS skip, count_if(active_ads = 0) AS silent FROM scored"),
]
FLAGSHIP = Operator("which_products_to_test", f"WITH {SCORES} SELECT product_id, p_name AS name, p_type AS category, active_ads, advertisers, markets, {_R('demand')}, {_R('momentum')}, {_R('saturation')}, quadrant, decision, {_R('opportunity')} FROM scored JOIN part ON p_partkey = product_id ORDER BY round(opportunity, 4) DESC, product_id")
OPERATORS.append(FLAGSHIP)
