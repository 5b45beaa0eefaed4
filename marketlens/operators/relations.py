"""Scans, filters, joins, set operations, sorts and windows."""

from marketlens.dialect import Operator
from marketlens.operators import classes, vectors
from marketlens.plans.views import ADS, BEHAVIOUR, DAY, WINDOW

_OFFER = "offer AS (SELECT l_partkey AS product_id, l_suppkey AS advertiser_id, @micros(l_shipdate) AS t, l_extendedprice / l_quantity AS price, l_orderkey AS o, l_linenumber AS n, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax) AS k FROM lineitem)"
_V02 = "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS found_id, round(@dot(q.embedding, e.embedding), 5) AS cosine FROM q CROSS JOIN embeddings e WHERE e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, found_id) AS k FROM s) SELECT query_id, found_id, cosine, k FROM r WHERE k <= 10"
#: The windows of an offer, the sort of all line items, work on partitions that don't grow with them.
_BY_OFFER = ("lineitem", ("l_partkey", "l_suppkey"))
OPERATORS = [
    Operator("s01_table_scan", "SELECT * FROM part"),
    Operator("s02_column_pruned_scan", "SELECT p_partkey, p_retailprice FROM part WHERE p_size > 20"),
    Operator("s16_manual_url_record", "SELECT page_id, substring(sha1(url), 1, 16) AS record_id, @extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages"),
    Operator("p01_ads_only", f"WITH {ADS} SELECT product_id, advertiser_id, first_seen, round(price, 2) AS price FROM ad WHERE channel = 'ads' OR channel IS NULL"),
    Operator("p03_market_scope", f"WITH {ADS} SELECT market, count(*) AS ads FROM ad WHERE region IN ('ASIA', 'EUROPE') OR market = 'NATION_1' GROUP BY market"),
    Operator("p05_active_at_date", f"WITH {ADS} SELECT product_id, count(*) AS active FROM ad WHERE first_seen <= {DAY} - 30 AND last_seen >= {DAY} - 31 GROUP BY product_id"),
    Operator("p07_advertiser_filter", f"WITH {ADS}, blocked AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 0) SELECT product_id, count(*) AS ads FROM ad WHERE NOT EXISTS (SELECT 1 FROM blocked WHERE id = advertiser_id) GROUP BY product_id"),
    Operator("p09_ad_list", f"WITH {ADS} SELECT product_id, advertiser_id, first_seen, last_seen, round(price, 2) AS price, variant, quantity FROM live WHERE media = 'video' AND price > 1000 ORDER BY {DAY} - first_seen DESC, product_id, advertiser_id, price, variant, quantity LIMIT 200"),
    Operator("p12_exact_keyword", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%and%'"),
    Operator("p13_variant_predicate", "SELECT doc_id FROM documents WHERE concat(' ', lower(text)) LIKE '% tion%'"),
    Operator("p14_keyword_tiers", "WITH t AS (SELECT doc_id, source, CASE WHEN lower(text) LIKE '%the of%' THEN 0 WHEN lower(text) LIKE '% the %' AND lower(text) LIKE '% of %' THEN 1 WHEN lower(text) LIKE '% the %' OR lower(text) LIKE '% of %' THEN 2 END AS tier FROM documents) SELECT source, tier, count(*) AS n FROM t WHERE tier IS NOT NULL GROUP BY source, tier"),
    Operator("p16_exclusion_keywords", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%the%' AND NOT lower(text) LIKE '%license%'"),
    Operator("p17_limited_expansion", "WITH t AS (SELECT doc_id, CASE WHEN text LIKE '%token%' THEN 0 WHEN text LIKE '%@%' THEN 2 END AS tier FROM documents) SELECT doc_id, tier FROM t WHERE tier < 2 OR (tier = 2 AND (SELECT count(*) FROM t WHERE tier < 2) < 30)"),
    Operator("p25_record_validation", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'text missing' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'language' WHEN length(text) < 200 THEN 'short' ELSE 'valid' END AS status FROM documents"),
    Operator("p28_plausible_price", f"WITH {ADS} SELECT CASE WHEN price / quantity < 0.5 THEN 'too low' WHEN price / quantity > 5000 THEN 'too high' ELSE 'plausible' END AS reason, count(*) AS n FROM ad GROUP BY 1"),
    Operator("p29_advertorial", "SELECT page_id, @rlike(url, '/(blog|article|news)/|[?&]page=') AS advertorial FROM pages"),
    Operator("j01_inner_join", f"WITH {ADS} SELECT p_brand AS brand, market, count(*) AS ads FROM ad JOIN part ON p_partkey = product_id GROUP BY p_brand, market"),
    Operator("j02_left_join", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    Operator("j03_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    Operator("j04_anti_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)"),
    Operator("j05_exists", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)"),
    Operator("j06_cogroup_by_product", "WITH a AS (SELECT l_partkey AS id, count(*) AS ads, @long(sum(l_quantity)) AS units FROM lineitem GROUP BY l_partkey), b AS (SELECT @json_int(props, '$.k') AS id, count(*) AS events FROM events GROUP BY 1) SELECT p_partkey AS product_id, coalesce(ads, 0) AS ads, coalesce(units, 0) AS units, coalesce(b.events, 0) AS n_events FROM part LEFT JOIN a ON a.id = p_partkey LEFT JOIN b ON b.id = p_partkey"),
    Operator("j08_shared_key_pairs", "WITH k AS (SELECT DISTINCT l_suppkey AS key, l_shipdate AS day, l_partkey AS id FROM lineitem), f AS (SELECT *, count(*) OVER (PARTITION BY key, day) AS fan FROM k) SELECT DISTINCT a.id AS a, b.id AS b FROM f a JOIN f b ON a.key = b.key AND a.day = b.day AND a.id < b.id WHERE a.fan BETWEEN 2 AND 6 AND b.fan BETWEEN 2 AND 6"),
    Operator("j09_token_set_pairs", "WITH t AS (SELECT p_partkey AS id, @list_sort(@list_distinct(@words(trim(@word_only(p_name))))) AS w FROM part), f AS (SELECT id, w, count(*) OVER (PARTITION BY w) AS fan FROM t WHERE @list_len(w) >= 2) SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.w = b.w AND a.id < b.id WHERE a.fan <= 6 AND b.fan <= 6"),
    Operator("j10_identity_star", "WITH g AS (SELECT p_partkey AS id, p_brand AS brand, p_type AS type_, p_size AS size_, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS head, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS fan FROM part) SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.brand = b.brand AND a.type_ = b.type_ AND a.size_ = b.size_ AND a.id < b.id WHERE a.fan <= 40 OR a.id = a.head"),
    Operator("j11_duplicate_ad_star", "WITH g AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha1(text)) AS head FROM documents) SELECT head AS a, id AS b FROM g WHERE head < id"),
    Operator("j12_hamming_join", """WITH h AS (SELECT DISTINCT p_partkey AS id, @unhex(substring(sha1(p_name), 1, 15)) AS h FROM part), d AS (SELECT DISTINCT h FROM h),
        n AS (SELECT x.h AS xh, y.h AS yh, bit_count(@xor(x.h, y.h)) AS distance FROM d x JOIN d y ON bit_count(@xor(x.h, y.h)) <= 16)
        SELECT DISTINCT x.id AS a, y.id AS b, distance FROM n JOIN h x ON x.h = n.xh JOIN h y ON y.h = n.yh WHERE x.id < y.id""",
        check="""WITH h AS (SELECT p_partkey AS id, @unhex(substring(sha1(p_name), 1, 15)) AS h FROM part)
        SELECT DISTINCT x.id AS a, y.id AS b, bit_count(@xor(x.h, y.h)) AS distance FROM h x JOIN h y ON x.id < y.id WHERE bit_count(@xor(x.h, y.h)) <= 16""", build=classes.hamming_join),
    Operator("j16_blocked_jaccard", """WITH t AS (SELECT p_partkey AS id, p_brand AS brand, @list_distinct(@words(lower(p_name))) AS w FROM part)
        SELECT a.id AS a, b.id AS b, round(@dbl(@list_len(@intersect(a.w, b.w))) / (@list_len(a.w) + @list_len(b.w) - @list_len(@intersect(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON a.brand = b.brand AND a.id < b.id
        WHERE @dbl(@list_len(@intersect(a.w, b.w))) / (@list_len(a.w) + @list_len(b.w) - @list_len(@intersect(a.w, b.w))) >= 0.6""", build=classes.blocked_jaccard),
    Operator("j20_as_of_join", f"""WITH {_OFFER}, q AS (SELECT DISTINCT product_id, advertiser_id, t + 2592000000000 AS asked FROM offer),
        u AS (SELECT product_id, advertiser_id, t AS at, 0 AS side, k, price FROM offer UNION ALL SELECT product_id, advertiser_id, asked, 1, NULL, NULL FROM q),
        w AS (SELECT product_id, advertiser_id, at AS asked, side, last_value(price) IGNORE NULLS OVER (PARTITION BY product_id, advertiser_id ORDER BY at, side, k ROWS UNBOUNDED PRECEDING) AS price FROM u)
        SELECT product_id, advertiser_id, asked, round(price, 8) AS price FROM w WHERE side = 1 AND price IS NOT NULL""",
        dealt=_BY_OFFER, check=f"WITH {_OFFER}, q AS (SELECT DISTINCT product_id, advertiser_id, t + 2592000000000 AS asked FROM offer), r AS (SELECT q.*, o.price, row_number() OVER (PARTITION BY q.product_id, q.advertiser_id, q.asked ORDER BY o.k DESC) AS r FROM q JOIN offer o ON o.product_id = q.product_id AND o.advertiser_id = q.advertiser_id AND o.t <= q.asked) SELECT product_id, advertiser_id, asked, round(price, 8) AS price FROM r WHERE r = 1"),
    Operator("j21_latest_row_join", f"WITH {_OFFER}, z AS (SELECT *, max(k) OVER (PARTITION BY product_id, advertiser_id) AS last_k FROM offer) SELECT product_id, advertiser_id, t, round(price, 8) AS price FROM z WHERE k = last_k", dealt=_BY_OFFER),
    Operator("j23_range_join", "WITH s AS (SELECT user_id, min(ts) AS since FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT e.user_id, count(*) AS later FROM events e JOIN s ON s.user_id = e.user_id AND e.ts >= s.since GROUP BY e.user_id"),
    Operator("j24_parent_roots", """WITH RECURSIVE link AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN @idiv(p_partkey, 3) ELSE p_partkey END AS parent FROM part),
        walk AS (SELECT id, parent FROM link UNION ALL SELECT w.id, l.parent FROM walk w JOIN link l ON l.id = w.parent WHERE l.parent <> w.parent)
        SELECT id, min(parent) AS root FROM walk GROUP BY id""", build=classes.parent_roots),
    Operator("j26_known_url_join", "WITH p AS (SELECT page_id, @extract(lower(url), '^https?://(?:www\\.|m\\.)?([^/?#]+)', 1) AS host FROM pages) SELECT a.host, count(*) AS pages, min(a.page_id) AS first_page FROM p a JOIN (SELECT host FROM p GROUP BY host HAVING count(*) > 1) k ON k.host = a.host GROUP BY a.host"),
    Operator("j27_broadcast_dimension", "SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"),
    Operator("w01_latest_per_key", f"WITH {_OFFER}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY t DESC, o DESC, n DESC, advertiser_id DESC, price DESC) AS r FROM offer) SELECT product_id, t, o, n, advertiser_id FROM r WHERE r = 1"),
    Operator("w02_change_detection", f"WITH {BEHAVIOUR}, l AS (SELECT user_id, event_id, kind, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM behaviour) SELECT user_id, event_id, kind FROM l WHERE before IS NULL OR before <> kind"),
    Operator("w05_first_last_delta", f"WITH {_OFFER} SELECT product_id, advertiser_id, round(max_by(price, k) - min_by(price, k), 6) AS delta FROM offer GROUP BY product_id, advertiser_id HAVING count(*) >= 2", dealt=_BY_OFFER),
    Operator("w06_consecutive_rises", f"WITH {_OFFER}, s AS (SELECT *, CASE WHEN price > lag(price) OVER w THEN 0 ELSE 1 END AS broke FROM offer WINDOW w AS (PARTITION BY product_id, advertiser_id ORDER BY k)), e AS (SELECT product_id, advertiser_id, max(k) AS last_k, max(CASE WHEN broke = 1 THEN k END) AS last_break FROM s GROUP BY product_id, advertiser_id) SELECT product_id, advertiser_id, last_k - last_break AS rises FROM e", dealt=_BY_OFFER),
    Operator("w07_price_stats", f"WITH {_OFFER} SELECT product_id, advertiser_id, count(*) AS n, round(min_by(price, k), 6) AS first_price, round(max_by(price, k), 6) AS last_price, round(min(price), 6) AS low, round(max(price), 6) AS high, round((max_by(price, k) / min_by(price, k) - 1) * 100, 4) AS change_pct FROM offer GROUP BY product_id, advertiser_id", dealt=_BY_OFFER),
    Operator("w08_first_appearance", f"WITH {ADS}, f AS (SELECT market, product_id, min(first_seen) AS since FROM ad GROUP BY market, product_id) SELECT market, count(*) AS products, count_if(since > {DAY} - {WINDOW}) AS new_products FROM f GROUP BY market"),
    Operator("w09_rank_gap_test", f"WITH {ADS}, c AS (SELECT product_id, market, count(*) AS n FROM ad GROUP BY product_id, market), r AS (SELECT product_id, market, n, row_number() OVER o AS k, lead(n) OVER o AS second FROM c WINDOW o AS (PARTITION BY product_id ORDER BY n DESC, market)) SELECT product_id, market, n - coalesce(second, 0) >= 2 AS accepted FROM r WHERE k = 1"),
    Operator("w10_top_k_per_group", f"WITH {ADS}, c AS (SELECT advertiser_id, product_id, count(*) AS n FROM ad GROUP BY advertiser_id, product_id), r AS (SELECT *, row_number() OVER (PARTITION BY advertiser_id ORDER BY n DESC, product_id) AS k FROM c) SELECT advertiser_id, product_id, n, k FROM r WHERE k <= 3"),
    Operator("w11_exploration_slots", "WITH n AS (SELECT p_partkey AS id, p_retailprice AS score, row_number() OVER (ORDER BY sha1(concat('u1:2024-01-31:', @str(p_partkey)))) AS e, @idiv((count(*) OVER () + 2), 5) AS picks FROM part), r AS (SELECT id, e, e <= picks AS explored, row_number() OVER (PARTITION BY e <= picks ORDER BY score DESC, id) AS k FROM n), slots AS (SELECT id, CASE WHEN explored THEN e * 5 ELSE k + @idiv((k - 1), 4) END AS slot, explored FROM r) SELECT id, row_number() OVER (ORDER BY slot, explored DESC, id) AS place, explored FROM slots"),
    Operator("w15_time_buckets", "SELECT @str(@week(ts)) AS week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, event_type"),
    Operator("w16_period_comparison", f"WITH {ADS} SELECT market, count_if(first_seen > {DAY} - {WINDOW}) AS now_, count_if(first_seen > {DAY} - 2 * {WINDOW} AND first_seen <= {DAY} - {WINDOW}) AS before FROM ad GROUP BY market"),
    Operator("w18_running_budget_trim", "WITH c AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) SELECT doc_id, source FROM c WHERE upto - n_chars < 5000"),
    Operator("o01_sort_offset_limit", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50 OFFSET 100"),
    Operator("o05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    Operator("o09_landing_selection", f"WITH {ADS}, r AS (SELECT product_id, advertiser_id, last_seen, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN channel = 'ads' THEN 0 ELSE 1 END, CASE WHEN last_seen >= {DAY} - 1 THEN 0 ELSE 1 END, last_seen DESC, advertiser_id) AS k FROM ad) SELECT product_id, advertiser_id, last_seen FROM r WHERE k = 1"),
    Operator("u01_union_candidates", "SELECT p_partkey AS id FROM part WHERE p_size > 45 UNION SELECT l_partkey FROM lineitem WHERE l_quantity >= 50"),
    Operator("u02_intersection", "SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'"),
    Operator("u03_difference", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08"),
    Operator("u04_array_set_algebra", f"WITH {ADS} SELECT product_id, @sorted_join(market) AS markets FROM ad GROUP BY product_id"),
    Operator("t04_bucket_dedup", f"WITH {BEHAVIOUR} SELECT DISTINCT user_id, kind, @idiv(@micros(ts), 1800000000) AS bucket FROM behaviour WHERE kind = 'view'"),
    Operator("t06_change_tracking", f"WITH {ADS}, a AS (SELECT DISTINCT product_id, advertiser_id FROM ad WHERE first_seen <= {DAY} - {WINDOW} AND last_seen >= {DAY} - {WINDOW}), b AS (SELECT DISTINCT product_id, advertiser_id FROM live) SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.advertiser_id, b.advertiser_id) AS advertiser_id, CASE WHEN a.product_id IS NULL THEN 'new_ad' WHEN b.product_id IS NULL THEN 'ad_unobserved' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.product_id = b.product_id AND a.advertiser_id = b.advertiser_id"),
    Operator("t10_ttl_expiry", f"WITH {BEHAVIOUR} SELECT user_id, count(*) AS kept FROM behaviour WHERE day > @dayno(DATE '2024-01-31') - CASE kind WHEN 'view' THEN 7 WHEN 'click' THEN 14 ELSE 30 END GROUP BY user_id"),
    Operator("r01_preference_profile", f"WITH {BEHAVIOUR}, s AS (SELECT user_id, p_type AS category, sum(weight * power(0.5, (@dayno(DATE '2024-01-31') - day) / @dbl(30))) AS w FROM behaviour JOIN part ON p_partkey = k + 1 GROUP BY user_id, p_type), r AS (SELECT *, max(w) OVER (PARTITION BY user_id) AS peak, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, category) AS place FROM s WHERE w > 0) SELECT user_id, category, round(w / peak, 8) AS share FROM r WHERE place <= 10"),
    Operator("r07_first_claim_wins", f"WITH {BEHAVIOUR}, r AS (SELECT k, user_id, event_id, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS n FROM behaviour WHERE kind = 'purchase') SELECT k, user_id, event_id FROM r WHERE n = 1"),
    Operator("v02_vector_top_k", _V02, build=lambda spark, sf: vectors.vector_top_k(spark, sf, Operator("v02_vector_top_k", _V02))),
    Operator("f22_url_functions", "SELECT page_id, @extract(url, '^([a-z]+)://', 1) AS scheme, @extract(url, '^https?://([^/?#]+)', 1) AS host, @replace_all(@replace_all(url, '[?#].*$', ''), '^https?://(www\\.|m\\.)?', '') AS landing_key FROM pages"),
    Operator("f23_hash_keys", "SELECT doc_id, substring(sha1(concat_ws('|', lang, source, substring(lower(text), 1, 150))), 1, 16) AS variation_key FROM documents"),
    Operator("f24_gtin_check_digit", "WITH g AS (SELECT p_partkey AS id, substring(@str(100000000000 + p_partkey * 7919), 1, 12) AS body FROM part), d AS (SELECT id, body, CAST(substring(body, 1, 1) AS INT) + CAST(substring(body, 3, 1) AS INT) + CAST(substring(body, 5, 1) AS INT) + CAST(substring(body, 7, 1) AS INT) + CAST(substring(body, 9, 1) AS INT) + CAST(substring(body, 11, 1) AS INT) + 3 * (CAST(substring(body, 2, 1) AS INT) + CAST(substring(body, 4, 1) AS INT) + CAST(substring(body, 6, 1) AS INT) + CAST(substring(body, 8, 1) AS INT) + CAST(substring(body, 10, 1) AS INT) + CAST(substring(body, 12, 1) AS INT)) AS s FROM g) SELECT id, concat(body, @str((10 - s % 10) % 10)) AS ean FROM d"),
    Operator("f30_normalisers", "SELECT p_partkey, round(greatest(0, least(100, (@dbl(p_retailprice) - 900) / 1100 * 100)), 6) AS lin, round(greatest(0, least(100, ln(1 + p_size) / ln(51) * 100)), 6) AS log_lin FROM part"),
    Operator("f32_force_score", f"WITH {ADS}, f AS (SELECT product_id, (60 * least(@dbl({DAY} - first_seen) / 180, 1) + 25 * least(@dbl(variant - 1) / 9, 1) + 15 * least(@dbl(quantity) / 40, 1)) * CASE WHEN last_seen >= {DAY} - 1 THEN 1 ELSE 0.7 END AS force FROM ad) SELECT product_id, round(max(force), 4) AS force_max, count_if(force >= 45) AS strong_ads, CASE WHEN max(force) >= 70 THEN 'A' WHEN max(force) >= 45 THEN 'B' WHEN max(force) >= 20 THEN 'C' ELSE 'D' END AS tier FROM f GROUP BY product_id"),
    Operator("f10_language_detector", "SELECT doc_id, lang, CASE WHEN @rlike(text, '[ßäöü]') THEN 'de' WHEN @rlike(text, '[ñóí]') THEN 'es' WHEN @rlike(text, '[éèêç]') THEN 'fr' ELSE 'en' END AS detected FROM documents"),
]
