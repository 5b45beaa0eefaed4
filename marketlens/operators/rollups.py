"""Aggregations by market, advertiser, product, day and source."""

from marketlens.dialect import Operator
from marketlens.plans.views import ADS, BEHAVIOUR, DAY, WINDOW

OPERATORS = [
    Operator("a03_conditional_counts", f"WITH {ADS} SELECT market, count(*) AS ads, count_if(media = 'video') AS videos, count_if(last_seen >= {DAY} - 1) AS live FROM ad GROUP BY market"),
    Operator("a04_count_distinct", f"WITH {ADS} SELECT region, count(DISTINCT advertiser_id) AS advertisers, count(DISTINCT product_id) AS products FROM ad GROUP BY region"),
    Operator("a06_duplication_ratio", f"WITH {ADS} SELECT product_id, round(1 - @dbl(count(DISTINCT variant)) / count(variant), 4) AS duplication FROM live GROUP BY product_id"),
    Operator("a07_weighted_mean", f"WITH {ADS} SELECT market, round(sum(discount * quantity) / sum(quantity), 6) AS weighted_discount FROM ad GROUP BY market"),
    Operator("a08_top5_mean", f"WITH {ADS}, f AS (SELECT product_id, 60 * least(@dbl({DAY} - first_seen) / 180, 1.0) + 25 * least(@dbl(variant - 1) / 9, 1.0) AS force FROM live), r AS (SELECT product_id, force, row_number() OVER (PARTITION BY product_id ORDER BY force DESC) AS k FROM f) SELECT product_id, round(avg(force), 4) AS force_top FROM r WHERE k <= 5 GROUP BY product_id"),
    Operator("a09_mode", f"WITH {ADS}, c AS (SELECT product_id, market, count(*) AS n FROM ad GROUP BY product_id, market), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY n DESC, market) AS k FROM c) SELECT product_id, market AS top_market, n FROM r WHERE k = 1"),
    Operator("a10_histogram_map", f"WITH {ADS}, c AS (SELECT market, channel, count(*) AS n FROM ad GROUP BY market, channel) SELECT market, array_join_placeholder AS histogram FROM c GROUP BY market".replace("array_join_placeholder", "@sorted_join(concat(channel, '=', @str(n)))")),
    Operator("a11_market_rollup", f"WITH {ADS} SELECT market, p_type AS category, count(DISTINCT product_id) AS products, count(*) AS ads, count_if(last_seen >= {DAY} - 2) AS active, count_if(first_seen > {DAY} - {WINDOW}) AS new_ads, count(DISTINCT advertiser_id) AS advertisers FROM ad JOIN part ON p_partkey = product_id GROUP BY market, p_type"),
    Operator("a11_market_rollup_totals", f"WITH {ADS} SELECT region, market, grouping(region) AS all_regions, grouping(market) AS all_markets, count(*) AS ads, count(DISTINCT advertiser_id) AS advertisers FROM ad GROUP BY ROLLUP (region, market)"),
    Operator("a12_advertiser_rollup", f"WITH {ADS} SELECT advertiser_id, count_if(last_seen >= {DAY} - 2) AS active, count_if(first_seen > {DAY} - 7) AS new_7d, count(DISTINCT product_id) AS products, count(DISTINCT market) AS countries FROM ad GROUP BY advertiser_id"),
    Operator("a13_market_dna", f"WITH {ADS}, c AS (SELECT market, p_type AS category, count(*) AS n FROM ad JOIN part ON p_partkey = product_id GROUP BY market, p_type) SELECT market, category, n, round(@dbl(n) / sum(n) OVER (PARTITION BY market), 6) AS share FROM c"),
    Operator("a14_live_market_table", f"WITH {ADS} SELECT region, market, count(*) AS total, count_if(last_seen >= {DAY} - 1) AS active, count_if(first_seen > {DAY} - {WINDOW}) AS new_ads, count_if(first_seen > {DAY} - 2 * {WINDOW} AND first_seen <= {DAY} - {WINDOW}) AS previous, CASE WHEN count_if(first_seen > {DAY} - {WINDOW}) > count_if(first_seen > {DAY} - 2 * {WINDOW} AND first_seen <= {DAY} - {WINDOW}) THEN 'up' ELSE 'flat' END AS trend FROM ad GROUP BY region, market"),
    Operator("a15_product_radar", f"WITH {ADS} SELECT product_id, count_if(last_seen >= {DAY} - 1) AS live, count_if(first_seen > {DAY} - {WINDOW}) AS new_ads, count_if(first_seen > {DAY} - 2 * {WINDOW} AND first_seen <= {DAY} - {WINDOW}) AS previous, count(DISTINCT advertiser_id) AS sellers, {DAY} - min(first_seen) AS age, max(variant) AS max_variation FROM ad GROUP BY product_id"),
    Operator("a16_competitor_radar", f"""WITH {ADS}, n AS (SELECT advertiser_id, count_if(first_seen > {DAY} - {WINDOW}) AS now_, count_if(first_seen > {DAY} - 2 * {WINDOW} AND first_seen <= {DAY} - {WINDOW}) AS before FROM ad GROUP BY advertiser_id)
        SELECT advertiser_id, now_, before, round(@dbl(now_ - before) / greatest(before, 1), 4) AS growth, now_ >= 8 AND now_ >= 2 * greatest(before, 1) AS scaling FROM n"""),
    Operator("a17_daily_pulse", f"WITH {BEHAVIOUR} SELECT @str(@date(ts)) AS day, count(*) AS events, count(DISTINCT user_id) AS users, count_if(kind = 'purchase') AS purchases, round(sum(value), 4) AS total FROM behaviour GROUP BY @date(ts)"),
    Operator("a18_comment_summary", "SELECT role, count(*) AS comments, round(avg(length(text)), 4) AS avg_length, count_if(text LIKE '%?%') AS questions FROM conversations GROUP BY role"),
    Operator("a19_price_margin", f"WITH {ADS}, p AS (SELECT product_id, @sorted_list(round(price / quantity, 8)) AS xs, count(*) AS n FROM ad GROUP BY product_id) SELECT product_id, @item(xs, 1) AS floor_price, @item(xs, @idiv(n, 2) + 1) AS upper_median, round(1 - @item(xs, 1) * 1.6 / @item(xs, @idiv(n, 2) + 1), 4) AS margin FROM p"),
    Operator("a20_null_preserving_sum", "SELECT d.source, @long(sum(l.quality)) AS quality_sum, count(*) AS documents FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 0 GROUP BY d.source"),
    Operator("a21_product_360", f"WITH {ADS} SELECT product_id, 'advertiser' AS kind, advertiser AS name, count(*) AS ads FROM live GROUP BY product_id, advertiser UNION ALL SELECT product_id, 'market', market, count(*) FROM live GROUP BY product_id, market UNION ALL SELECT product_id, 'media', media, count(*) FROM live GROUP BY product_id, media"),
    Operator("a22_offer_comparison", f"WITH {ADS} SELECT product_id, channel, round(min(price / quantity), 8) AS lowest, round(max(price / quantity), 8) AS highest, round((max(price / quantity) - min(price / quantity)) / min(price / quantity) * 100, 2) AS gap_pct FROM ad GROUP BY product_id, channel"),
    Operator("a23_shop_rollup", f"WITH {ADS}, c AS (SELECT advertiser_id, p_type AS category, count(*) AS n FROM ad JOIN part ON p_partkey = product_id GROUP BY advertiser_id, p_type), r AS (SELECT *, row_number() OVER (PARTITION BY advertiser_id ORDER BY n DESC, category) AS k FROM c) SELECT advertiser_id, @long(sum(n)) AS listings, @sorted_join(CASE WHEN k <= 3 THEN category END) AS top_categories FROM r GROUP BY advertiser_id"),
    Operator("a24_having", "SELECT l_partkey AS product_id, l_suppkey AS advertiser_id, count(*) AS snapshots FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) >= 2"),
    Operator("a25_coherent_range", f"""WITH {ADS}, s AS (SELECT product_id, price / quantity AS p, row_number() OVER (PARTITION BY product_id ORDER BY price / quantity) AS k, count(*) OVER (PARTITION BY product_id) AS n FROM ad),
        t AS (SELECT product_id, p, n, row_number() OVER (PARTITION BY product_id ORDER BY p) AS j, count(*) OVER (PARTITION BY product_id) AS m FROM s WHERE n < 4 OR (k > @idiv(n, 4) AND k <= n - @idiv(n, 4)))
        SELECT product_id, round(min(p), 4) AS low, round(max(p), 4) AS high, round(max(CASE WHEN j = @idiv(m, 2) + 1 THEN p END), 4) AS middle FROM t GROUP BY product_id HAVING max(p) / min(p) <= 6"""),
    Operator("a26_weighted_percentile", f"""WITH {ADS}, c AS (SELECT market, price / quantity AS p, quantity AS w, sum(quantity) OVER (PARTITION BY market ORDER BY price / quantity) AS upto, sum(quantity) OVER (PARTITION BY market) AS total FROM ad)
        SELECT market, round(min(CASE WHEN upto >= .25 * total THEN p END), 4) AS p25, round(min(CASE WHEN upto >= .5 * total THEN p END), 4) AS p50, round(min(CASE WHEN upto >= .75 * total THEN p END), 4) AS p75 FROM c GROUP BY market"""),
    Operator("a27_decayed_sum", f"WITH {BEHAVIOUR} SELECT user_id, round(sum(weight * power(0.5, (@dayno(DATE '2024-01-31') - day) / @dbl(30))), 6) AS interest FROM behaviour GROUP BY user_id"),
    Operator("a28_normalised_top_n", f"WITH {BEHAVIOUR}, s AS (SELECT user_id, sum(weight) AS w FROM behaviour GROUP BY user_id), r AS (SELECT user_id, w, max(w) OVER () AS peak, row_number() OVER (ORDER BY w DESC, user_id) AS k FROM s WHERE w > 0) SELECT user_id, k AS place, round(w / peak, 6) AS share FROM r WHERE k <= 10"),
    Operator("a30_catalogue_metrics", f"WITH {ADS}, p AS (SELECT product_id, count(*) AS n FROM ad GROUP BY product_id) SELECT count(*) AS products, count_if(n = 1) AS single_ad, round(avg(n), 6) AS ads_per_product FROM p"),
    Operator("a31_collector_kpis", "SELECT source, count(*) AS collected, count(DISTINCT text) AS distinct_texts, round(1 - @dbl(count(DISTINCT text)) / count(*), 6) AS duplicate_ratio, count_if(text IS NULL OR text = '') AS empty FROM documents GROUP BY source"),
    Operator("a32_network_summary", f"WITH {ADS} SELECT channel, count(*) AS total, count_if(first_seen > {DAY} - 1) AS new_24h FROM ad GROUP BY channel"),
    Operator("a33_storage_budget", "SELECT lang AS bucket, count(*) AS files, @long(sum(n_chars)) AS chars FROM documents GROUP BY lang"),
    Operator("a34_quota_usage", f"WITH {BEHAVIOUR} SELECT kind AS pool, count_if(day > @dayno(DATE '2024-01-31') - 30) AS this_month, count_if(day = @dayno(DATE '2024-01-30')) AS today, greatest(0, 3000 - count_if(day > @dayno(DATE '2024-01-31') - 30)) AS remaining FROM behaviour GROUP BY kind"),
    Operator("a35_video_facts", f"WITH {ADS} SELECT product_id, variant, count(*) AS ads, count(DISTINCT advertiser_id) AS pages, count(DISTINCT CASE WHEN last_seen >= {DAY} - 1 THEN advertiser_id END) AS live_pages, min(first_seen) AS first_seen, count(DISTINCT advertiser_id) > 8 AS generic FROM ad WHERE media = 'video' GROUP BY product_id, variant"),
    Operator("a36_creative_reuse", f"WITH {ADS}, m AS (SELECT product_id, variant, advertiser_id, min(first_seen) AS since FROM ad GROUP BY product_id, variant, advertiser_id) SELECT product_id, variant, count(*) AS pages, count_if(since > {DAY} - 7) AS new_7d, round(count_if(since > {DAY} - 7) / @dbl(7), 6) AS velocity FROM m GROUP BY product_id, variant"),
    Operator("a38_taste_model", "WITH v AS (SELECT d.source AS feature, CASE WHEN l.quality = 1 THEN 100.0 ELSE 0.0 END AS vote FROM labels l JOIN documents d ON d.doc_id = l.doc_id) SELECT feature, count(*) AS votes, round(@dbl(sum(vote) + 100) / (count(*) + 2), 6) AS taste FROM v GROUP BY feature HAVING count(*) >= 3"),
    Operator("a39_dominant_label", f"WITH {ADS}, c AS (SELECT advertiser_id, market, count(*) AS n FROM ad GROUP BY advertiser_id, market), s AS (SELECT *, @dbl(n) / sum(n) OVER (PARTITION BY advertiser_id) AS share FROM c) SELECT advertiser_id, market, round(share, 6) AS share FROM s WHERE share >= 0.8"),
    Operator("a41_behaviour_summary", f"WITH {BEHAVIOUR}, kinds AS (SELECT @explode(@split_on('view,click,purchase,signup,error,skip', ',')) AS kind), c AS (SELECT kind, count(*) AS n FROM behaviour GROUP BY kind) SELECT k.kind, coalesce(n, 0) AS n FROM kinds k LEFT JOIN c ON c.kind = k.kind"),
    Operator("a42_interest_counts", f"WITH {BEHAVIOUR}, m AS (SELECT k, user_id, max(CASE kind WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS level FROM behaviour GROUP BY k, user_id) SELECT k, count_if(level = 2) AS favourites, count_if(level = 1) AS saved FROM m GROUP BY k"),
    Operator("a44_overview_grouping_sets", f"WITH {ADS} SELECT channel, media, market, count(*) AS ads FROM ad GROUP BY GROUPING SETS ((channel), (media), (market))"),
    Operator("a45_pivot_review_status", "SELECT lang, count_if(l.quality = 1) AS approved, count_if(l.quality = 0) AS rejected, count_if(l.quality IS NULL) AS pending FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang"),
    Operator("a46_scope_facets", f"WITH {ADS}, s AS (SELECT * FROM live WHERE region = 'ASIA') SELECT 'channel' AS facet, channel AS name, count(*) AS n FROM s GROUP BY channel UNION ALL SELECT 'media', media, count(*) FROM s GROUP BY media"),
]
