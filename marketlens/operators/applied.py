"""The DataFrame functions of this library applied to the given tables, each with SQL of its own for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.dialect import Query
from marketlens.functions import compare, money, rules, text
from marketlens.functions.rounding import rounded
from marketlens.operators import classes, entities, search
from marketlens.sources import exports, feeds, lake

SCRIPTS = {"ar": r"\p{InArabic}", "th": r"\p{InThai}", "ja": r"[\p{InHiragana}\p{InKatakana}]", "zh": r"\p{IsHan}", "ru": r"\p{InCyrillic}", "ko": r"\p{IsHangul}"}
WORDS = {
    "en": ("the", "and", "of", "to", "is", "for", "with", "in", "on"),
    "de": ("der", "die", "und", "das", "ist", "mit", "für", "den", "nicht"),
    "fr": ("le", "la", "les", "et", "des", "est", "pour", "dans", "que"),
    "es": ("el", "los", "las", "y", "de", "es", "para", "con", "que"),
}
MARKS = {"vi": "[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]"}
CURRENCIES = ("USD", "EUR", "VND", "PHP", "SAR", "XXX")


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _docs(build):
    return lambda spark, sf: _read(spark, sf, "documents").select("doc_id", *build())


def _parts(*build):
    return lambda spark, sf: _read(spark, sf, "part").select("p_partkey", *(b() for b in build))


def _offers(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.col("l_linenumber") < 7, F.element_at(F.array(*map(F.lit, CURRENCIES)), F.least(F.col("l_linenumber").cast("int"), F.lit(6))))
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("price"), code.alias("currency"))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    a = _read(spark, sf, "part")
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("name_b"), F.col("p_brand").alias("brand_b"), F.col("p_type").alias("type_b"), F.col("p_retailprice").cast("double").alias("price_b"))
    return a.select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_retailprice").cast("double").alias("price_a")).join(b, "p_partkey")


def _identity(spark: SparkSession, sf: str) -> DataFrame:
    n = _neighbours(spark, sf)
    none = F.lit(None).cast("string")
    left = {"gtin": none, "brand": F.col("p_brand"), "model": none, "sku": F.col("p_type")}
    right = {"gtin": none, "brand": F.col("brand_b"), "model": none, "sku": F.col("type_b")}
    return n.select("p_partkey", compare.identity_match(left, right).alias("same"))


def _products(spark: SparkSession, sf: str) -> DataFrame:
    ads = _read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n_ads"))
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 30, "CONFIRMED").when(F.col("p_size") > 5, "SUGGESTED").otherwise("UNKNOWN").alias("status"), F.col("p_type").alias("category"), F.col("p_retailprice").cast("double").alias("price"), (F.col("p_size") > 45).alias("manual"), "p_brand", "p_size")
    return p.join(ads, "id", "left").na.fill(0, ["n_ads"])


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    p = _products(spark, sf)
    brand = p.select("id", F.concat_ws("|", "p_brand", "category", "p_size").alias("key"))
    name = p.select("id", F.concat_ws("|", F.lower("name"), "p_brand").alias("key"))
    return entities.evidence(entities.key_pairs(brand, "key", "landing").union(entities.key_pairs(name, "key", "copy")))


def _pair_scores(spark: SparkSession, sf: str, exact: bool) -> DataFrame:
    same = compare.jaccard(F.array_distinct("tokens_a"), F.array_distinct("tokens_b")) if exact else None
    out = entities.scored(_evidence(spark, sf), _products(spark, sf), similarity=same)
    return out.withColumn("kinds", F.array_join("kinds", ",")).withColumn("blockers", F.array_join("blockers", ","))


def _search(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search(_read(spark, sf, "documents"), "text", ["the of", "license"], synonyms={"license": [["licence", "copyright"], ["the", "and"]]}, related={"the of": ["token"]}, exclude=["forbidden"])
    return search.page(hits, search.by_relevance(hits, [F.desc("n_chars"), F.asc("doc_id")]), 0, 200).select("doc_id", "tier", "n_strong")


def _throttled(hours: float):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        rows = _offers(spark, sf).select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("timestamp").alias("at"), F.round("price", 0).alias("price"))
        return lake.kept_snapshots(rows, ["l_partkey", "l_suppkey"], "at", ["price"], hours).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("kept"))

    return build


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    pages = _read(spark, sf, "pages").select(F.col("page_id").alias("Ad-ID"), F.col("url").alias("Link"), F.lit("  ").alias("Page Name"))
    good, bad = exports.validated(exports.mapped(pages), required=("external_id", "advertiser"))
    return good.select("external_id", "landing_page", F.lit("").alias("reason")).union(bad.select("external_id", "landing_page", F.array_join("reasons", ";")))


_KEPT = """WITH RECURSIVE o AS (SELECT l_partkey, l_suppkey, l_shipdate AS seen, round(l_extendedprice / l_quantity, 0) AS price FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY seen, price) AS k FROM o),
    w AS (SELECT l_partkey, l_suppkey, k, seen, price, 1 AS kept FROM n WHERE k = 1 UNION ALL
          SELECT n.l_partkey, n.l_suppkey, n.k, CASE WHEN x.go THEN n.seen ELSE w.seen END, CASE WHEN x.go THEN n.price ELSE w.price END, x.go::INT
          FROM w JOIN n ON n.l_partkey = w.l_partkey AND n.l_suppkey = w.l_suppkey AND n.k = w.k + 1,
               LATERAL (SELECT n.price <> w.price OR epoch_us(n.seen) - epoch_us(w.seen) >= {hours} * 3600000000 AS go) x)
    SELECT l_partkey, l_suppkey, sum(kept)::BIGINT AS kept FROM w GROUP BY l_partkey, l_suppkey"""
_TRIM = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}\p{Pc}\s''-]', ' ', 'g'), '\s+', ' ', 'g'))"
_PLAIN = r"lower(regexp_replace(strip_accents(replace(coalesce({0}, ''), 'ß', 'ss')), '[^\x00-\x7F]', '', 'g'))"
_RATE = "CASE coalesce(currency, 'USD') WHEN 'USD' THEN 1.0 WHEN 'EUR' THEN 1.08 WHEN 'VND' THEN 0.00004 WHEN 'PHP' THEN 0.018 WHEN 'SAR' THEN 0.27 END::DOUBLE"
_OFFER = "o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS price, CASE l_linenumber WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'VND' WHEN 4 THEN 'PHP' WHEN 5 THEN 'SAR' WHEN 6 THEN 'XXX' END AS currency FROM lineitem)"
_PAIR = "n AS (SELECT a.p_partkey, a.p_name, a.p_brand, a.p_type, a.p_retailprice::DOUBLE AS price_a, b.p_name AS name_b, b.p_brand AS brand_b, b.p_type AS type_b, b.p_retailprice::DOUBLE AS price_b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"
_TOKENS = r"list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+')), lambda t: CASE WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, -1) ELSE t END))"
_SLUG = "regexp_replace(path, '[-_/]', ' ', 'g')"
_SHARE = "len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1})))"

OPERATORS = [
    Query("f01_fold", _docs(lambda: [F.md5(text.fold("text")).alias("folded")]), f"SELECT doc_id, md5({_TRIM}) AS folded FROM documents"),
    Query("f02_fold_ascii", _docs(lambda: [F.md5(text.fold_ascii("text")).alias("folded")]), f"SELECT doc_id, md5({_PLAIN.format('text')}) AS folded FROM documents"),
    Query("f03_copy_key", _docs(lambda: [text.normal_copy("text").alias("copy")]), r"SELECT doc_id, substr(trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{M}\p{N}\p{Pc}]+', ' ', 'g')), 1, 150) AS copy FROM documents"),
    Query("f04_squash", _docs(lambda: [text.squash("text").alias("squashed")]), r"SELECT doc_id, substr(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}\p{Pc}]+', '', 'g'), 1, 120) AS squashed FROM documents"),
    Query("f05_tokenizers", _docs(lambda: [F.size(text.ascii_tokens("text", 3, ("the", "and"))).alias("n_ascii"), F.size(text.letter_tokens("text")).alias("n_letters")]), f"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all({_PLAIN.format('text')}, '[a-z0-9]+')), lambda t: length(t) >= 3 AND t NOT IN ('the', 'and')))::INT AS n_ascii, len(list_distinct(regexp_extract_all({_TRIM}, '\\p{{L}}{{3,}}')))::INT AS n_letters FROM documents"),
    Query("f06_title_key", _parts(lambda: text.title_key("p_name", "p_brand").alias("key")), f"WITH t AS (SELECT p_partkey, list_sort(list_filter(list_distinct(regexp_extract_all({_PLAIN.format('p_name')}, '[a-z0-9]+')), lambda t: length(t) >= 2)) AS w, regexp_replace({_PLAIN.format('p_brand')}, '[^a-z0-9]', '', 'g') AS b FROM part) SELECT p_partkey, CASE WHEN len(w) >= 2 THEN concat(CASE WHEN b <> '' THEN concat(b, '|') ELSE '' END, substr(array_to_string(w, ' '), 1, 240)) END AS key FROM t"),
    Query("p11_split_keywords", _parts(lambda: F.array_join(text.split_keywords(F.concat_ws(" | ", "p_brand", "p_type", F.concat(F.lit(" , "), F.col("p_brand")))), "/").alias("keywords")), "SELECT p_partkey, CASE WHEN lower(p_brand) = lower(p_type) THEN lower(trim(p_brand)) ELSE concat(lower(trim(p_brand)), '/', lower(trim(p_type))) END AS keywords FROM part"),
    Query("f11_text_reliability", _docs(lambda: [text.word_count("text").cast("long").alias("words"), text.reliability(text.word_count("text"), F.col("lang")).alias("reliability"), text.needs_text(text.reliability(text.word_count("text"), F.col("lang")), F.col("lang")).alias("needs_text")]), r"WITH w AS (SELECT doc_id, lang, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}'']+')) AS words FROM documents), r AS (SELECT *, CASE WHEN words < 3 THEN 0 ELSE round(least(1.0, words::DOUBLE / 12) * CASE WHEN lang IN ('en', 'vi', 'tl', 'ar') THEN 1.0 WHEN lang <> 'und' THEN 0.5 ELSE 0.6 END, 3) END::DOUBLE AS reliability FROM w) SELECT doc_id, words, reliability, reliability < 0.5 AND lang IN ('en', 'vi', 'tl', 'ar', 'und') AS needs_text FROM r"),
    Query("f10_language_by_shares", _docs(lambda: [text.detected_language("text", SCRIPTS, WORDS, MARKS).alias("detected")])),
    Query("f22_plain_url", lambda s, d: _read(s, d, "pages").select("page_id", text.plain_url("url").alias("plain"), text.without_parameters(F.concat("url", F.when(F.contains(F.col("url"), F.lit("?")), "&").otherwise("?"), F.lit("utm_source=a&id=3&ref=x#top"))).alias("clean"), F.array_join(F.array_sort(text.slug_tokens("url")), " ").alias("slug")),
          f"WITH u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '([?&])(ref|utm_[a-z]+)=[^&#]*&?', '\\1', 'g'), '[?&]+$', '') AS c, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, concat(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '://', regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''), regexp_replace(path, '/+$', '')) AS plain, concat(c, CASE WHEN c LIKE '%?%' THEN '&' ELSE '?' END, 'id=3#top') AS clean, array_to_string(list_sort({_TOKENS.format(_SLUG)}), ' ') AS slug FROM u"),
    Query("f23_cross_source_key", lambda s, d: _read(s, d, "pages").select("page_id", text.cross_source_key(F.lit("Ann"), F.col("html"), F.col("url")).alias("key")), r"SELECT page_id, substr(sha1(concat('ann|', substr(regexp_replace(lower(coalesce(html, '')), '[^\p{L}\p{M}\p{N}\p{Pc}]+', '', 'g'), 1, 120), '|', regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1))), 1, 16) AS key FROM pages"),
    Query("f37_date_formats", lambda s, d: _read(s, d, "orders").select("o_orderkey", F.date_format(text.parsed_time(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))), "yyyy-MM-dd").alias("day")), "SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day FROM orders"),
    Query("p26_scrub", lambda s, d: _read(s, d, "pages").select("page_id", text.scrubbed(F.concat("url", F.lit("?token=abc&x=1"))).alias("url")), "SELECT page_id, concat(url, '?token=***&x=1') AS url FROM pages"),
    Query("f16_usd", lambda s, d: _offers(s, d).select("l_orderkey", "l_linenumber", rounded(money.usd(F.col("price"), F.col("currency")), 6).alias("usd"), money.segment(F.col("price"), F.col("currency")).alias("segment"), money.plausible(F.col("price"), F.col("currency"), F.lit("PHP")).alias("doubt")),
          f"WITH {_OFFER}, u AS (SELECT *, price * {_RATE} AS usd FROM o) SELECT l_orderkey, l_linenumber, round(usd, 6) AS usd, CASE WHEN usd < 15 THEN 'budget' WHEN usd < 35 THEN 'mid' WHEN usd < 70 THEN 'upper' WHEN usd IS NOT NULL THEN 'premium' END AS segment, CASE WHEN currency NOT IN ('USD', 'EUR', 'GBP', 'PHP') THEN 'currency' WHEN usd IS NULL THEN 'unknown currency' WHEN usd < 0.5 THEN 'too low' WHEN usd > 5000 THEN 'too high' END AS doubt FROM u"),
    Query("f20_prices_in_text", lambda s, d: _read(s, d, "documents").select("doc_id", money.parsed_price(F.concat(F.lit("only $"), F.col("n_chars").cast("string"), F.lit(".50 now"))).alias("p")).select("doc_id", "p.amount", "p.currency"), "SELECT doc_id, n_chars + 0.5::DOUBLE AS amount, 'USD' AS currency FROM documents"),
    Query("f39_landed_cost", lambda s, d: _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", money.landed_cost(F.col("l_extendedprice"), F.when(F.col("l_linenumber") % 2 == 0, 4.5), F.col("l_linenumber") < 4).alias("c")).select("l_orderkey", "l_linenumber", "c.value", F.array_join("c.missing", ",").alias("missing")),
          "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND l_linenumber < 4 THEN (round(l_extendedprice * 100)::BIGINT + 450) / 100.0 END AS value, concat_ws(',', CASE WHEN l_linenumber % 2 <> 0 THEN 'shipping' END, CASE WHEN l_linenumber >= 4 THEN 'vat_included' END) AS missing FROM lineitem"),
    Query("f25_identity_compare", _identity, f"WITH {_PAIR} SELECT p_partkey, CASE WHEN lower(trim(p_brand)) <> lower(trim(brand_b)) THEN false ELSE lower(trim(p_type)) = lower(trim(type_b)) END AS same FROM n"),
    Query("f26_model_numbers", lambda s, d: _neighbours(s, d).select("p_partkey", F.array_join(compare.numeric_models(F.col("p_brand")), " ").alias("models"), compare.compatible_titles(F.col("p_brand"), F.col("brand_b")).alias("compatible")), f"WITH {_PAIR} SELECT p_partkey, array_to_string(list_distinct(regexp_extract_all(lower(p_brand), '\\b(?:[a-z]+-?)?[0-9]+[a-z]*\\b')), ' ') AS models, len(list_filter(regexp_extract_all(lower(p_brand), '\\b(?:[a-z]+-?)?[0-9]+[a-z]*\\b'), lambda m: NOT list_contains(regexp_extract_all(lower(brand_b), '\\b(?:[a-z]+-?)?[0-9]+[a-z]*\\b'), m))) = 0 AS compatible FROM n"),
    Query("f27_set_ratios", lambda s, d: _neighbours(s, d).select("p_partkey", rounded(compare.jaccard(text.name_tokens("p_name"), text.name_tokens("name_b")), 6).alias("jaccard"), rounded(compare.containment(text.name_tokens("p_name"), text.name_tokens("name_b")), 6).alias("containment"), rounded(compare.price_similarity(F.col("price_a"), F.col("price_b")), 6).alias("price_similarity")),
          f"WITH {_PAIR}, t AS (SELECT *, {_TOKENS.format('p_name')} AS x, {_TOKENS.format('name_b')} AS y FROM n) SELECT p_partkey, round({_SHARE.format('x', 'y')}, 6) AS jaccard, round(len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)), 6) AS containment, round(least(price_a, price_b) / greatest(price_a, price_b), 6) AS price_similarity FROM t"),
    Query("f28_title_similarity", lambda s, d: _neighbours(s, d).select("p_partkey", F.round(compare.title_similarity(text.name_tokens("p_name"), text.name_tokens("name_b")), 6).alias("similarity"))),
    Query("f24_valid_gtin", _parts(lambda: compare.valid_gtin(F.lpad(F.col("p_partkey").cast("string"), 8, "4")).alias("valid")), "WITH d AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 8, '4') AS g FROM part) SELECT p_partkey, (10 - (3 * (substr(g, 7, 1)::INT + substr(g, 5, 1)::INT + substr(g, 3, 1)::INT + substr(g, 1, 1)::INT) + substr(g, 6, 1)::INT + substr(g, 4, 1)::INT + substr(g, 2, 1)::INT) % 10) % 10 = substr(g, 8, 1)::INT AS valid FROM d"),
    Query("f33_trend_and_freshness", lambda s, d: _read(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_linenumber") == 1).alias("a"), F.count_if(F.col("l_linenumber") == 2).alias("b")).select("l_suppkey", rules.trend(F.col("a"), F.col("b")).alias("t"), rules.freshness(F.col("l_suppkey") % 30).alias("freshness")).select("l_suppkey", "t.arrow", "t.growth", "freshness"),
          "WITH c AS (SELECT l_suppkey, count(*) FILTER (l_linenumber = 1) AS a, count(*) FILTER (l_linenumber = 2) AS b FROM lineitem GROUP BY 1), g AS (SELECT *, CASE WHEN b <> 0 THEN a::DOUBLE / b - 1 END AS g FROM c) SELECT l_suppkey, CASE WHEN g >= 1 THEN '↑↑↑' WHEN g >= 0.4 THEN '↑↑' WHEN g >= 0.1 THEN '↑' WHEN g <= -0.5 THEN '↓↓' WHEN g <= -0.1 THEN '↓' WHEN g IS NOT NULL THEN '→' WHEN a <> 0 THEN 'NEW' ELSE '–' END AS arrow, round(g, 3) AS growth, CASE WHEN l_suppkey % 30 < 1 THEN 'fresh' WHEN l_suppkey % 30 < 6 THEN 'recent' WHEN l_suppkey % 30 < 24 THEN 'stale' ELSE 'unreliable' END AS freshness FROM g"),
    Query("f18_star_sentiment", lambda s, d: _read(s, d, "part").select("p_partkey", rules.sentiment_of_stars(F.col("p_size") % 6).alias("sentiment"), rules.win_label(F.col("p_size") * 2).alias("label"), rules.backoff(F.col("p_size") % 12 + 1).alias("wait")), "SELECT p_partkey, CASE WHEN p_size % 6 >= 4 THEN 'positive' WHEN p_size % 6 <= 2 THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN p_size * 2 >= 75 THEN 'Likely Winner' WHEN p_size * 2 >= 60 THEN 'Potential Winner' WHEN p_size * 2 >= 45 THEN 'Mixed Signals' ELSE 'Weak Signals' END AS label, least(3600, 60 * 2 ** (p_size % 12))::BIGINT AS wait FROM part"),
    Query("f38_page_age", lambda s, d: _read(s, d, "lineitem").select("l_orderkey", "l_linenumber", rules.page_age(F.col("l_shipdate").cast("date"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int") * 4)).alias("a")).select("l_orderkey", "l_linenumber", "a.days_older", "a.flag"), "SELECT l_orderkey, l_linenumber, (l_linenumber * 4)::INT AS days_older, l_linenumber * 4 > 14 AS flag FROM lineitem"),
    Query("f40_compliance_risk", lambda s, d: _read(s, d, "documents").select("doc_id", rules.compliance_risk(F.col("text")).alias("r")).select("doc_id", "r.risk", F.array_join("r.flags", ",").alias("flags"))),
    Query("f34_distances", lambda s, d: (lambda e: e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", compare.hamming(F.col("vec_id").cast("long"), F.col("vec_id").cast("long") * 7919).cast("long").alias("bits"), rounded(compare.clamped(compare.cosine(F.col("embedding"), F.col("other")), 0.2, 0.9), 4).alias("closeness")))(_read(s, d, "embeddings").select("vec_id", "embedding")),
          "SELECT a.vec_id, bit_count(xor(a.vec_id::BIGINT, a.vec_id::BIGINT * 7919))::BIGINT AS bits, round(greatest(0, least(1, (list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) - 0.2) / (0.9 - 0.2))), 4) AS closeness FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    Query("f35_same_video", _parts(lambda: compare.same_video(F.array(F.col("p_partkey").cast("long"), F.col("p_size").cast("long"), F.when(F.col("p_size") > 9, F.col("p_partkey").cast("long"))), F.array(F.lit(None).cast("long"), F.lit(7).cast("long"), F.lit(3).cast("long")), 3).alias("same")), "SELECT p_partkey, CASE WHEN p_size > 9 THEN bit_count(xor(p_size::BIGINT, 7::BIGINT)) <= 3 AND bit_count(xor(p_partkey::BIGINT, 3::BIGINT)) <= 3 END AS same FROM part"),
    Query("e06_pair_evidence", lambda s, d: _evidence(s, d).withColumn("kinds", F.array_join("kinds", ",")),
          "WITH k AS (SELECT p_partkey AS id, concat_ws('|', p_brand, p_type, p_size) AS key, 'landing' AS kind FROM part UNION ALL SELECT p_partkey, concat_ws('|', lower(p_name), p_brand), 'copy' FROM part), g AS (SELECT *, count(*) OVER (PARTITION BY kind, key) AS fan, min(id) OVER (PARTITION BY kind, key) AS head FROM k), e AS (SELECT DISTINCT a.id AS a, b.id AS b, a.kind FROM g a JOIN g b USING (kind, key) WHERE a.id < b.id AND (a.fan <= 40 OR a.id = a.head)) SELECT a, b, string_agg(kind, ',' ORDER BY kind) AS kinds FROM e GROUP BY a, b"),
    Query("e07_pair_scores", lambda s, d: _pair_scores(s, d, False)),
    Query("e09_verdicts", lambda s, d: _pair_scores(s, d, True).groupBy("verdict", "relation", "blockers").agg(F.count("*").alias("pairs"), F.round(F.avg("score"), 4).alias("score"))),
    Query("e11_merge_targets", lambda s, d: entities.merge_targets(_pair_scores(s, d, True).where("verdict IN ('auto', 'pending')").select("a", "b"), _products(s, d).select("id", "status", "manual", "n_ads"))),
    Query("j14_best_match", lambda s, d: classes.best_match(*(lambda t: (t, t))(_read(s, d, "part").select(F.col("p_partkey").alias("id"), text.name_tokens("p_name").alias("tokens"), F.concat_ws("|", "p_brand", "p_type").alias("block"))), "block"),
          f"WITH t AS (SELECT p_partkey AS id, {_TOKENS.format('p_name')} AS w, concat_ws('|', p_brand, p_type) AS k FROM part), p AS (SELECT a.id AS left_id, b.id AS right_id, {_SHARE.format('a.w', 'b.w')} AS s FROM t a JOIN t b ON a.k = b.k AND a.id <> b.id WHERE len(list_intersect(a.w, b.w)) > 0), r AS (SELECT *, row_number() OVER o AS k, lead(s) OVER o AS second FROM p WINDOW o AS (PARTITION BY left_id ORDER BY s DESC, right_id)) SELECT left_id, right_id, round(s, 6) AS similarity, s >= 0.55 AND s - coalesce(second, 0) >= 0.15 AS accepted FROM r WHERE k = 1"),
    Query("p10_search", _search,
          "WITH t AS (SELECT doc_id, n_chars, lower(coalesce(text, '')) AS t FROM documents), k AS (SELECT *, CASE WHEN regexp_matches(t, '(^|[^\\p{L}\\p{M}\\p{N}_])the') AND regexp_matches(t, '(^|[^\\p{L}\\p{M}\\p{N}_])of') THEN 0 WHEN t LIKE '%token%' THEN 2 END AS a, CASE WHEN t LIKE '%license%' THEN 0 WHEN (t LIKE '%licence%' OR t LIKE '%copyright%') AND (regexp_matches(t, '(^|[^\\p{L}\\p{M}\\p{N}_])the') OR regexp_matches(t, '(^|[^\\p{L}\\p{M}\\p{N}_])and')) THEN 1 END AS b FROM t WHERE t NOT LIKE '%forbidden%'), h AS (SELECT doc_id, n_chars, least(coalesce(a, 9), coalesce(b, 9)) AS tier, CASE WHEN a < 2 THEN 1 ELSE 0 END + CASE WHEN b < 2 THEN 1 ELSE 0 END AS n_strong FROM k), c AS (SELECT count(*) AS strong FROM h WHERE tier < 2) SELECT doc_id, tier, n_strong FROM h, c WHERE tier < 9 AND (tier < 2 OR strong < 30) ORDER BY n_strong DESC, tier, n_chars DESC, doc_id LIMIT 200"),
    Query("a46_facets", lambda s, d: search.facets(_read(s, d, "documents"), ["lang", "source"]), "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source"),
    Query("s05_header_aliases", _mapped, "SELECT page_id::VARCHAR AS external_id, url AS landing_page, 'missing advertiser' AS reason FROM pages"),
    Query("s14_landing_facts", lambda s, d: feeds.landing_facts(_read(s, d, "pages").select("page_id", "html")).select("page_id", "title", "price", "currency", "rating")),
    Query("s20_latest_listing", lambda s, d: lake.latest(_offers(s, d).select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber"), ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]), "SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1"),
    Query("t08_state_changes", lambda s, d: lake.changes(_read(s, d, "part").where("p_size > 5").select("p_partkey", "p_brand", "p_size"), _read(s, d, "part").where("p_size < 40").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1).alias("p_size")), ["p_partkey"], ["p_brand", "p_size"]), "SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'new' WHEN p_size >= 40 THEN 'gone' WHEN p_size % 2 = 0 THEN 'same' ELSE 'changed' END AS change FROM part"),
    Query("w03_throttled_snapshot", _throttled(24), _KEPT.format(hours=24)),
    Query("w04_throttled_signal", _throttled(12), _KEPT.format(hours=12)),
]
