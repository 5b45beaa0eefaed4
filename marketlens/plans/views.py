"""Domain views: advertisements, products, advertisers, listings' prices and behaviour, as common table expressions.

Times are whole days since 1970, so all date arithmetic is on integers. An advertisement runs ten days for each unit of its
quantity; DAY is the date that all figures refer to, WINDOW the length of the periods that are compared.
"""

DAY, WINDOW = "@dayno(DATE '2001-06-30')", 90

ADS = f"""ad AS (
    SELECT l_partkey AS product_id, l_suppkey AS advertiser_id, @dayno(l_shipdate) AS first_seen,
           @dayno(l_shipdate) + CAST(10 * l_quantity AS INT) AS last_seen, l_extendedprice AS price, l_quantity AS quantity,
           l_linenumber AS variant, CASE l_returnflag WHEN 'A' THEN 'marketplace' WHEN 'R' THEN 'organic' ELSE 'ads' END AS channel,
           CASE l_linestatus WHEN 'O' THEN 'video' ELSE 'image' END AS media, l_discount AS discount,
           n_name AS market, n_nationkey AS market_no, r_name AS region, s_name AS advertiser
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE @dayno(l_shipdate) <= {DAY}),
live AS (SELECT * FROM ad WHERE last_seen >= {DAY} - 1)"""

#: Distinct counts need no copies of rows: an advertiser's first row has own = 1, and markets, variants and channels, few and numbered
#: under 64, are bits. One scan: rows of (product, advertiser, market, variant, channel), with the advertiser's own figures beside them by window;
#: all features come from one aggregation of these. Quantity stands for engagement, a marketplace seller for a store.
FEATURES = f"""{ADS},
core AS (
    SELECT product_id, advertiser_id, market, variant, channel, min(market_no) AS market_no, CASE channel WHEN 'ads' THEN 0 WHEN 'organic' THEN 1 ELSE 2 END AS channel_no, count(*) AS n, count_if(last_seen >= {DAY} - 1) AS active,
           count_if(first_seen > {DAY} - {WINDOW}) AS new_n, count_if(first_seen > {DAY} - 2 * {WINDOW} AND first_seen <= {DAY} - {WINDOW}) AS prev_n,
           count_if(last_seen < {DAY} - 1 AND last_seen > {DAY} - {WINDOW}) AS removed_n, count_if(last_seen >= {DAY} - 1 AND {DAY} - first_seen >= 30) AS running,
           count_if(last_seen >= {DAY} - 1 AND force >= 45) AS strong, min(first_seen) AS since, sum(price / quantity) AS prices, sum(quantity) AS engagement,
           max(CASE WHEN last_seen >= {DAY} - 1 THEN {DAY} - first_seen END) AS longest, max(CASE WHEN last_seen >= {DAY} - 1 THEN force END) AS force
    FROM (SELECT *, (60 * least(@dbl({DAY} - first_seen) / 180, 1) + 25 * least(@dbl(variant - 1) / 9, 1) + 15 * least(@dbl(quantity) / 40, 1)) * CASE WHEN last_seen >= {DAY} - 1 THEN 1 ELSE 0.7 END AS force FROM ad) z
    GROUP BY product_id, advertiser_id, market, variant, channel),
beside AS (
    SELECT *, sum(active) OVER w AS own_active, min(since) OVER w AS own_since, max(CASE WHEN channel = 'marketplace' THEN 1 ELSE 0 END) OVER w AS own_shop,
           CASE WHEN row_number() OVER (PARTITION BY product_id, advertiser_id ORDER BY market, variant, channel) = 1 THEN 1 ELSE 0 END AS own
    FROM core WINDOW w AS (PARTITION BY product_id, advertiser_id)),
whole AS (
    SELECT product_id, @long(sum(n)) AS total_ads, @long(sum(active)) AS active_ads, @long(sum(new_n)) AS new_ads, @long(sum(prev_n)) AS prev_ads, @long(sum(removed_n)) AS removed_ads,
           @long(sum(running)) AS running_30d, @long(sum(strong)) AS strong_ads, @long(sum(own)) AS all_advertisers, @kinds(market_no) AS all_markets,
           @kinds(CASE WHEN active > 0 THEN variant END) AS unique_ads, @long(sum(CASE WHEN own_active > 0 THEN own ELSE 0 END)) AS live_advertisers,
           @kinds(CASE WHEN active > 0 THEN market_no END) AS live_markets, @kinds(channel_no) AS sources,
           @long(sum(own * own_shop)) AS stores, coalesce(max(longest), 0) AS longevity_days, coalesce(max(force), 0.0) AS force_top,
           max(active) AS variants, @long(sum(CASE WHEN own_since > {DAY} - {WINDOW} THEN own ELSE 0 END)) AS new_advertisers, sum(@dbl(active) * own_active) AS squares,
           {DAY} - min(since) AS data_days, sum(prices) / sum(n) AS avg_price, @dbl(sum(engagement)) / sum(n) AS engagement_per_ad
    FROM beside GROUP BY product_id),
feature AS (
    SELECT product_id, total_ads, active_ads, unique_ads, new_ads, prev_ads, removed_ads, running_30d, strong_ads, longevity_days, force_top, stores, sources, engagement_per_ad,
           greatest(1, variants) AS variants, CASE WHEN active_ads > 0 THEN live_advertisers ELSE all_advertisers END AS advertisers, new_advertisers,
           CASE WHEN active_ads > 0 THEN squares / (@dbl(active_ads) * active_ads) ELSE 1.0 END AS advertiser_hhi,
           CASE WHEN active_ads > 0 THEN live_markets ELSE all_markets END AS markets, new_ads - prev_ads AS acceleration,
           @dbl(new_ads) / greatest(3, active_ads) AS growth, @dbl(new_advertisers) / greatest(1, CASE WHEN active_ads > 0 THEN live_advertisers ELSE all_advertisers END - new_advertisers) AS advertiser_growth,
           CASE WHEN active_ads > 0 THEN 1 - @dbl(unique_ads) / active_ads ELSE 0 END AS duplication, avg_price, data_days
    FROM whole)"""


def linear(x: str, lo: float, hi: float) -> str:
    """(x - lo) / (hi - lo) as a percentage between 0 and 100; 50 where x is unknown."""
    return f"coalesce(greatest(0.0, least(100.0, (@dbl({x}) - {lo}) / ({hi} - {lo}) * 100)), 50.0)"


def logarithmic(x: str, lo: float, hi: float) -> str:
    return f"greatest(0.0, least(100.0, (ln(1.0 + {x}) - ln(1.0 + {lo})) / (ln(1.0 + {hi}) - ln(1.0 + {lo})) * 100))"


#: Fixed values of the formulas. Demand: one seller proves nothing, two to ten validate. Saturation: two to ten are healthy.
SELLERS = "CASE WHEN advertisers <= 1 THEN 0.0 WHEN advertisers = 2 THEN 60.0 WHEN advertisers <= 10 THEN 100.0 WHEN advertisers <= 15 THEN 70.0 ELSE 40.0 END"
CROWD = f"CASE WHEN advertisers < 2 THEN 15.0 WHEN advertisers <= 10 THEN 0.0 ELSE {linear('advertisers', 10, 20)} END"
#: What has no source here takes the neutral value of the formulas: market fit and appeal 50, wave and creative 30, compliance risk 0.
MARGIN = "CASE WHEN avg_price BETWEEN 15 AND 60 THEN 75.0 WHEN avg_price < 15 THEN 55.0 WHEN avg_price IS NULL THEN 55.0 ELSE 60.0 END"
_WIN = f"""(.15 * (.4 * {linear('force_top', 15, 70)} + .3 * {linear('@dbl(running_30d) / greatest(1, unique_ads)', 0, .4)} + .3 * {linear('running_30d', 0, 20)})
            + .15 * (.5 * {linear('new_ads', 0, 30)} + .5 * {linear('growth', 0, .8)}) + .10 * (.6 * {linear('advertiser_growth', 0, .4)} + .4 * {linear('new_advertisers', 0, 6)})
            + .10 * {linear('1 - advertiser_hhi', 0, .85)} + .10 * (.7 * {linear('markets', 1, 5)}) + .10 * {linear('engagement_per_ad', 0, 400)} + .10 * (.5 * {linear('stores', 0, 12)}))"""

SCORES = f"""{FEATURES},
parts AS (
    SELECT f.*, .35 * {logarithmic('longevity_days', 7, 120)} + .30 * greatest({logarithmic('unique_ads', 1, 10)}, {linear('variants', 1, 5)}, {linear('strong_ads', 1, 5)})
                + .20 * {SELLERS} + .15 * {linear('markets', 1, 4)} AS demand,
           .6 * {linear('new_ads', 0, 5)} + .4 * {linear('new_advertisers', 0, 3)} AS momentum,
           (.25 * {CROWD} + .15 * {linear('duplication', 0, 0.45)} + .15 * {linear('unique_ads', 2, 12)} + .15 * {linear('stores', 1, 4)}
            + .10 * CASE WHEN prev_ads >= 3 THEN {linear('-@dbl(acceleration) / greatest(1, prev_ads)', 0, .6)} ELSE 0.0 END) / .80 AS saturation,
           (.35 * (100 - {linear('advertisers', 1, 4)}) + .25 * (100 - {linear('unique_ads', 1, 12)}) + .20 * (100 - {linear('stores', 1, 4)})) / .80 AS rarity,
           .6 * {linear('growth', 0, 1.2)} + .4 * {linear('advertiser_growth', 0, .8)} AS velocity,
           (.25 * {linear('total_ads', 1, 80)} + .20 * {linear('advertisers', 1, 15)} + .20 * {linear('data_days', 3, 60)} + .10 * {linear('markets', 1, 4)} + .10 * {linear('sources', 1, 3)}) / .85 AS confidence,
           CASE WHEN stores > 0 THEN ({_WIN} + .12 * (.5 * 50 + .25 * 50 + .25 * {linear('sources', 1, 5)})) / .92 ELSE {_WIN} / .80 END AS raw_win,
           {MARGIN} AS margin,
           (.30 * (100 - {linear('advertisers', 2, 15)}) + .20 * (100 - {linear('stores', 1, 4)}) + .20 * {linear('60 - data_days', 0, 60)} + .15 * (100 - {linear('markets', 1, 6)})) / .85 AS novelty
    FROM feature f),
quad AS (
    SELECT *, greatest(0.0, least(100.0, raw_win - .6 * greatest(0.0, saturation - 60))) AS win,
           CASE WHEN momentum >= 40 AND demand >= 50 THEN 'BREAKOUT' WHEN momentum >= 40 THEN 'EXPERIMENTAL'
                WHEN demand >= 50 THEN 'STABLE_WINNER' ELSE 'LOW_SIGNAL' END AS quadrant,
           CASE WHEN prev_ads >= 5 AND new_ads < .5 * prev_ads AND removed_ads > new_ads AND saturation >= 35 THEN 'Declining' WHEN saturation < 25 THEN 'Low Saturation'
                WHEN saturation < 45 THEN 'Growing' WHEN saturation < 68 THEN 'Competitive' ELSE 'Highly Saturated' END AS saturation_state
    FROM parts),
decided AS (
    SELECT *, CASE WHEN active_ads = 0 THEN 'SKIP' WHEN advertisers > 15 OR saturation >= 70 THEN 'SKIP'
                   WHEN quadrant = 'BREAKOUT' AND longevity_days >= 14 THEN 'TEST_NOW' WHEN quadrant IN ('BREAKOUT', 'EXPERIMENTAL') THEN 'TEST'
                   WHEN demand >= 55 AND (advertisers >= 2 OR variants >= 2) THEN 'TEST' WHEN demand >= 45 OR momentum >= 20 THEN 'WATCH' ELSE 'SKIP' END AS decision,
           100 * exp(.35 * ln(greatest(1.0, win) / 100) + .25 * ln(greatest(1.0, rarity) / 100) + .2 * ln(greatest(1.0, velocity) / 100) + .1 * ln(.5) + .1 * ln(margin / 100)) AS rare_winner,
           (.5 * win + .2 * (100 - saturation) + .15 * velocity + .15 * margin) * (.4 + .6 * confidence / 100) AS opportunity_v1
    FROM quad),
scored AS (
    SELECT *, least(CASE decision WHEN 'SKIP' THEN 30.0 WHEN 'REVIEW' THEN 30.0 WHEN 'WATCH' THEN 55.0 ELSE 100.0 END,
                    greatest(0.0, least(100.0, (.28 * demand + .14 * momentum + .12 * 50 + .10 * 50 + .08 * novelty + .08 * 30 + .08 * 30 + .12 * margin
                                                - .12 * greatest(0.0, saturation - 30)) * (.75 + .25 * confidence / 100)))) AS opportunity
    FROM decided)"""

BEHAVIOUR = """behaviour AS (
    SELECT event_id, ts, user_id, event_type AS kind, value, @json_int(props, '$.k') AS k, @dayno(ts) AS day,
           @dbl(CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 2.0 WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.2 ELSE -0.5 END) AS weight
    FROM events)"""
