"""Further filters, joins, sorts and state operators over the domain views."""

from marketlens.dialect import Operator
from marketlens.operators import classes
from marketlens.plans.views import ADS, BEHAVIOUR, DAY, FEATURES, SCORES

_PRICE = "o AS (SELECT l_partkey AS product_id, l_suppkey AS shop_id, @dayno(l_shipdate) AS day, l_orderkey AS ord, l_linenumber AS line, @dbl(l_extendedprice) / @dbl(l_quantity) AS price, l_discount AS discount FROM lineitem)"
_TITLE = "t AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS type_, @list_distinct(@words(trim(@word_only(p_name)))) AS w FROM part)"
OPERATORS = [
    Operator("p02_external_ads", f"WITH {ADS} SELECT product_id, count(*) AS ads FROM ad WHERE (channel IS NULL OR channel = 'ads') AND coalesce(media, '') NOT IN ('removed') GROUP BY product_id"),
    Operator("p04_as_of_visibility", f"WITH {ADS}, d AS (SELECT {DAY} - 30 * k AS day FROM (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) z) SELECT day, count(*) AS visible FROM ad JOIN d ON first_seen < day + 1 GROUP BY day"),
    Operator("p06_liveness", f"WITH {ADS} SELECT market, count_if(last_seen >= {DAY} - 1) AS live, count_if(last_seen < {DAY} - 1 AND last_seen >= {DAY} - 7) AS lately FROM ad GROUP BY market"),
    Operator("p15_name_predicate", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%part%' OR p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE lower(s_name) LIKE '%supplier%1' AND l_quantity > 48)"),
    Operator("p18_reported_engagement", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 0 AND event_type = 'purchase') GROUP BY user_id"),
    Operator("p19_funnel_fit", f"WITH {ADS}, s AS (SELECT product_id, channel, count(*) AS n FROM ad GROUP BY product_id, channel), w AS (SELECT *, sum(n) OVER (PARTITION BY product_id) AS total FROM s) SELECT product_id, channel FROM w WHERE @dbl(n) / @dbl(total) >= 0.3"),
    Operator("p23_library_filter", f"WITH {SCORES} SELECT product_id, decision FROM scored WHERE decision IN ('TEST', 'WATCH') AND markets >= 2 AND advertisers BETWEEN 2 AND 10"),
    Operator("p21_listing_filters", f"WITH {_PRICE} SELECT product_id, shop_id, min(price) AS lowest FROM o WHERE discount >= 0.02 AND price BETWEEN 900 AND 1500 GROUP BY product_id, shop_id HAVING count(*) >= 1"),
    Operator("p22_result_modes", f"WITH {_PRICE}, p AS (SELECT *, min(price) OVER (PARTITION BY product_id) AS lowest FROM o) SELECT product_id, shop_id, ord, line, CASE WHEN price = lowest THEN 'exact' WHEN price <= 1.1 * lowest THEN 'compare_prices' ELSE 'find_suppliers' END AS mode FROM p"),
    Operator("j07_lateral_top_k", f"WITH {_PRICE} SELECT p_partkey, z.shop_id, round(z.price, 6) AS price FROM part, LATERAL (SELECT shop_id, price FROM o WHERE product_id = p_partkey ORDER BY price, shop_id, ord, line LIMIT 2) z",
             check=f"WITH {_PRICE}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, shop_id, ord, line) AS k FROM o) SELECT p_partkey, shop_id, round(price, 6) AS price FROM part JOIN r ON product_id = p_partkey WHERE k <= 2"),
    Operator("j15_identity_join", f"WITH {ADS}, i AS (SELECT advertiser_id, min(advertiser) AS name FROM ad GROUP BY advertiser_id), k AS (SELECT advertiser_id, name FROM i WHERE advertiser_id IS NOT NULL), u AS (SELECT name FROM i WHERE advertiser_id IS NULL), m AS (SELECT s_suppkey, k.name FROM supplier JOIN k ON k.advertiser_id = s_suppkey UNION ALL SELECT s_suppkey, u.name FROM supplier JOIN u ON u.name = s_name) SELECT z.s_suppkey, m.name FROM supplier z LEFT JOIN m ON m.s_suppkey = z.s_suppkey", check=f"WITH {ADS}, i AS (SELECT advertiser_id, min(advertiser) AS name FROM ad GROUP BY advertiser_id) SELECT s_suppkey, i.name FROM supplier LEFT JOIN i ON i.advertiser_id = s_suppkey"),
    Operator("j17_substring_join", "WITH b AS (SELECT DISTINCT lower(p_brand) AS brand FROM part), w AS (SELECT DISTINCT page_id, @explode(@words(trim(@word_only(html)))) AS word FROM pages) SELECT page_id, count(*) AS brands FROM w JOIN b ON b.brand = w.word OR b.brand = concat('brand#', w.word) GROUP BY page_id",
             check="WITH b AS (SELECT DISTINCT lower(p_brand) AS brand FROM part), w AS (SELECT DISTINCT page_id, word FROM (SELECT page_id, @explode(@words(trim(@word_only(html)))) AS word FROM pages)) SELECT page_id, count(*) AS brands FROM w JOIN b ON b.brand = w.word OR b.brand = concat('brand#', w.word) GROUP BY page_id"),
    Operator("j18_text_candidates", f"WITH {_TITLE}, e AS (SELECT id, brand, @explode(w) AS token FROM t), c AS (SELECT brand, token, count(*) AS fan FROM e GROUP BY brand, token) SELECT a.id AS a, b.id AS b, count(*) AS shared FROM e a JOIN c ON c.brand = a.brand AND c.token = a.token AND c.fan BETWEEN 2 AND 30 JOIN e b ON b.brand = a.brand AND b.token = a.token AND b.id > a.id GROUP BY a.id, b.id HAVING count(*) >= 2"),
    Operator("j19_post_matching", "WITH p AS (SELECT page_id, @extract(lower(url), '^https?://([^/?#]+)', 1) AS host FROM pages), h AS (SELECT host, min(page_id) AS first_id, count(*) AS n FROM p GROUP BY host) SELECT p.page_id, h.first_id, CASE WHEN p.page_id = h.first_id THEN 'exact' WHEN h.n <= 3 THEN 'likely' ELSE 'weak' END AS match FROM p JOIN h ON h.host = p.host"),
    Operator("j22_ttl_join", f"WITH {_PRICE}, q AS (SELECT product_id, max(day) AS asked FROM o GROUP BY product_id) SELECT q.product_id, count(*) AS fresh, round(min(o.price), 6) AS best FROM q JOIN o ON o.product_id = q.product_id AND o.day > q.asked - 30 AND o.day <= q.asked GROUP BY q.product_id"),
    Operator("j25_cluster_guard", f"WITH {_PRICE}, c AS (SELECT product_id, min(price) AS lo, max(price) AS hi, count(DISTINCT shop_id) AS shops FROM o GROUP BY product_id) SELECT product_id, hi > 3 * lo AS price_gap, shops FROM c"),
    Operator("o03_relevance_order", "SELECT doc_id, n, k FROM (SELECT doc_id, CASE WHEN lower(text) LIKE '% the %' THEN 1 ELSE 0 END + CASE WHEN lower(text) LIKE '% of %' THEN 1 ELSE 0 END AS n, n_chars AS k FROM documents) z ORDER BY n DESC, k DESC NULLS LAST, doc_id LIMIT 100"),
    Operator("o04_ad_sorts", " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, l_orderkey, l_linenumber FROM lineitem ORDER BY {by}, l_orderkey, l_linenumber LIMIT 40) z_{name}" for name, by in (("newest", "l_shipdate DESC"), ("variants", "l_linenumber DESC"), ("price", "l_extendedprice DESC"), ("sold", "l_quantity DESC"), ("cheapest", "l_extendedprice")))),
    Operator("o06_insufficient_last", f"WITH {FEATURES} SELECT product_id, data_days < 60 AS insufficient, round(growth, 6) AS growth FROM feature ORDER BY data_days < 60, round(growth, 6) DESC, product_id LIMIT 100"),
    Operator("o07_tiered_similarity", f"WITH {_TITLE}, s AS (SELECT a.id AS a, b.id AS b, @list_len(@intersect(a.w, b.w)) AS shared, a.type_ = b.type_ AS same_type FROM t a JOIN t b ON a.brand = b.brand AND a.id % 20 = 0 AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY CASE WHEN same_type AND shared >= 2 THEN 0 WHEN shared >= 2 THEN 1 ELSE 2 END, shared DESC, b) AS k FROM s) SELECT a, b, shared, k FROM r WHERE k <= 5", build=classes.tiered_similarity),
    Operator("o08_cover_selection", f"WITH {ADS}, r AS (SELECT product_id, advertiser_id, media, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN media = 'video' THEN 0 ELSE 1 END, CASE WHEN last_seen >= {DAY} - 1 THEN 0 ELSE 1 END, last_seen DESC, advertiser_id, variant, first_seen, price) AS k FROM ad) SELECT product_id, advertiser_id, media FROM r WHERE k = 1"),
    Operator("w12_pinned_slots", "WITH l AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events), f AS (SELECT *, place % 5 = 0 AS pinned FROM l), s AS (SELECT user_id, place, row_number() OVER (PARTITION BY user_id ORDER BY place) AS k FROM f WHERE NOT pinned), v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM f WHERE NOT pinned) SELECT user_id, event_id, place FROM f WHERE pinned UNION ALL SELECT v.user_id, v.event_id, s.place FROM v JOIN s ON s.user_id = v.user_id AND s.k = v.k"),
    Operator("w13_activity_momentum", f"""WITH {ADS}, d AS (SELECT {DAY} - 14 + 7 * k AS day, k FROM (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) z),
        cohort AS (SELECT DISTINCT product_id, advertiser_id, variant FROM ad WHERE first_seen <= {DAY} - 14),
        c AS (SELECT a.product_id, d.k, count(DISTINCT concat(@str(a.advertiser_id), '/', @str(a.variant))) AS n FROM ad a JOIN cohort h ON h.product_id = a.product_id AND h.advertiser_id = a.advertiser_id AND h.variant = a.variant JOIN d ON a.first_seen <= d.day AND a.last_seen >= d.day GROUP BY a.product_id, d.k),
        s AS (SELECT product_id, coalesce(max(CASE WHEN k = 0 THEN n END), 0) AS before, coalesce(max(CASE WHEN k = 1 THEN n END), 0) AS mid, coalesce(max(CASE WHEN k = 2 THEN n END), 0) AS last_n FROM c GROUP BY product_id)
        SELECT product_id, before, mid, last_n, mid - before >= 1 AND @dbl(mid - before) / greatest(1, before) >= 0.2 AND last_n - before >= 1 AND @dbl(last_n - before) / greatest(1, before) >= 0.2 AS confirmed FROM s"""),
    Operator("w14_entrants", f"WITH {ADS}, f AS (SELECT product_id, advertiser_id, min(first_seen) AS since FROM ad GROUP BY product_id, advertiser_id) SELECT product_id, advertiser_id, row_number() OVER (PARTITION BY product_id ORDER BY since, advertiser_id) AS arrival FROM f"),
    Operator("w17_job_sequence", f"WITH {BEHAVIOUR}, e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM behaviour WHERE kind = 'error') SELECT user_id, event_id, @long(least(3600, 60 * power(2, least(n, 12) - 1))) AS wait FROM e"),
    Operator("u05_union_in_order", "SELECT kind, id FROM (SELECT 1 AS k, 'product' AS kind, p_partkey AS id FROM part UNION ALL SELECT 2, 'store', s_suppkey FROM supplier UNION ALL SELECT 3, 'signal', event_id FROM events) z"),
    Operator("a29_cluster_groups", f"WITH {ADS}, c AS (SELECT product_id, advertiser_id, count(*) AS n FROM ad GROUP BY product_id, advertiser_id) SELECT product_id, count(*) AS members, max(n) AS largest, @sorted_join(@str(advertiser_id)) AS advertisers FROM c GROUP BY product_id"),
    Operator("a40_name_vote", f"WITH {ADS}, v AS (SELECT product_id, advertiser, count(*) AS votes FROM ad GROUP BY product_id, advertiser), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY votes DESC, advertiser) AS k, sum(votes) OVER (PARTITION BY product_id) AS total FROM v) SELECT product_id, advertiser AS name, @dbl(votes) / @dbl(total) >= 0.5 AS majority FROM r WHERE k = 1"),
    Operator("t05_state_flips", f"WITH {BEHAVIOUR}, l AS (SELECT user_id, event_id, kind = 'error' AS bad, lag(kind = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM behaviour) SELECT user_id, event_id, bad FROM l WHERE was IS NOT NULL AND was <> bad"),
    Operator("t07_fan_out", f"WITH {BEHAVIOUR}, f AS (SELECT DISTINCT user_id, k FROM behaviour WHERE kind = 'click') SELECT DISTINCT f.user_id, b.event_id FROM behaviour b JOIN f ON f.k = b.k WHERE b.kind = 'purchase' AND f.user_id <> b.user_id", build=classes.told_of_purchases),
    Operator("t09_late_data", f"WITH {BEHAVIOUR}, m AS (SELECT user_id, event_id, day, max(day) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM behaviour) SELECT user_id, event_id, seen - day AS days_late FROM m WHERE seen > day"),
    Operator("x14_market_fit", f"""WITH {ADS}, m AS (SELECT market, count_if(last_seen >= {DAY} - 1) AS active FROM ad GROUP BY market), c AS (SELECT market, p_type AS category, count_if(last_seen >= {DAY} - 1) AS n FROM ad JOIN part ON p_partkey = product_id GROUP BY market, p_type)
        SELECT c.market, c.category, round(50 + (greatest(0.0, least(100.0, @dbl(n) / greatest(1, active) / 0.35 * 100)) - 50) * least(1.0, @dbl(active) / 150), 4) AS fit FROM c JOIN m ON m.market = c.market"""),
    Operator("x21_advertiser_identity", f"WITH {ADS} SELECT product_id, count(DISTINCT coalesce(@str(advertiser_id), lower(advertiser))) AS advertisers, count_if(advertiser_id IS NULL AND advertiser IS NULL) AS unknown FROM ad GROUP BY product_id"),
    Operator("x22_activity_capture", f"WITH {ADS} SELECT product_id, {DAY} AS captured, count(DISTINCT advertiser_id * 10 + variant) AS known, count(DISTINCT CASE WHEN last_seen >= {DAY} - 1 THEN advertiser_id * 10 + variant END) AS active, @sorted_join(market) AS markets FROM ad GROUP BY product_id"),
    Operator("x25_rarity_in_dataset", f"""WITH {_PRICE}, s AS (SELECT product_id, count(*) AS listings, min(day) AS since, count(DISTINCT shop_id) AS shops, avg(price) AS price FROM o GROUP BY product_id), b AS (SELECT p_partkey AS id, count(*) OVER (PARTITION BY p_brand, p_type) - 1 AS alike FROM part)
        SELECT product_id, @long(round(least(1.0, CASE WHEN listings <= 2 THEN 0.3 ELSE 0 END + CASE WHEN alike <= 2 THEN 0.25 ELSE 0 END + CASE WHEN {DAY} - since <= 14 THEN 0.15 ELSE 0 END + CASE WHEN shops = 1 THEN 0.1 ELSE 0 END + CASE WHEN price < 920 OR price > 1900 THEN 0.1 ELSE 0 END) * 100)) AS score FROM s JOIN b ON b.id = product_id"""),
    Operator("x28_best_fresh_price", f"WITH {_PRICE}, z AS (SELECT *, max(day) OVER (PARTITION BY product_id) AS last_day FROM o), r AS (SELECT product_id, shop_id, price, row_number() OVER (PARTITION BY product_id ORDER BY price, shop_id, ord, line) AS k FROM z WHERE day > last_day - 30) SELECT product_id, shop_id, round(price, 6) AS price FROM r WHERE k = 1"),
    Operator("x29_engagement_summary", "SELECT user_id, count(*) AS n, count_if(event_type = 'view') AS views, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS spent, count_if(event_type = 'error') AS errors FROM events GROUP BY user_id"),
    Operator("e18_title_groups", "WITH t AS (SELECT p_partkey AS id, concat(lower(p_brand), '|', trim(@word_only(p_name))) AS key FROM part) SELECT key, count(*) AS n, min(id) AS head FROM t GROUP BY key"),
    Operator("e15_impure_clusters", f"WITH {ADS}, c AS (SELECT product_id, channel, count(*) AS n, avg(price / quantity) AS price FROM ad GROUP BY product_id, channel) SELECT product_id, count(*) AS parts, max(price) > 1.5 * min(price) AS impure FROM c GROUP BY product_id"),
]
