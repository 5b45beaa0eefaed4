"""Creatives: families of one picture or video, replication within a product, observations of reuse.

Equality of a digest, an address or a family links by a star around the least creative, never by all pairs; nearness of pictures
links different hashes, found by bands. What is linked is gathered by connected components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.dialect import Query
from marketlens.operators.graph import components
from marketlens.operators.hamming import led, near_hashes
from marketlens.sources.store import stored

#: Bits between pictures of one family, hashes of plain pictures, strength of the kinds of evidence.
NEAR = 6
TRIVIAL = (0, -1)
KINDS = ("same_file", "poster_phash", "video_fp_v1", "video_fp_v2")


def _stars(rows: DataFrame, by: list[str], node: str) -> DataFrame:
    """a, b: each row linked to the least node that shares the key; one minimum for each key and a join of one row for each."""
    keyed = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in by))
    least = keyed.groupBy(*by).agg(F.min(node).alias("_least"))
    return keyed.join(least, by).where(F.col(node) != F.col("_least")).select(F.col(node).alias("a"), F.col("_least").alias("b"))


def families(creatives: DataFrame) -> DataFrame:
    """creatives (id, type, sha256, video_fp, phash) -> id, family: the least id of the same file, the same frames, or pictures of
    one type within NEAR bits (E16).

    Equal covers of videos with different frames are not one family. A creative whose frames are unknown may be near several of them:
    such creatives, gathered by their pictures, go to the one family that is nearest, then least, and bridge none.
    """
    c = creatives.select("id", "type", "sha256", "video_fp", F.when(~F.col("phash").isin(*TRIVIAL), F.col("phash")).alias("hash"))
    sure = _stars(c, ["sha256"], "id").union(_stars(c, ["video_fp"], "id"))
    cores = components(sure).withColumnRenamed("node", "id").withColumnRenamed("root", "core")
    c = stored(c.join(cores, "id", "left").withColumn("core", F.coalesce("core", "id")), "creatives")
    framed = c.groupBy("core").agg(F.max(F.col("video_fp").isNotNull()).alias("framed"))
    c = stored(c.join(framed, "core"), "creatives")
    spots = c.where("hash IS NOT NULL").groupBy("type", "hash", "framed").agg(F.min("core").alias("least")).where("NOT framed")
    loose = c.where("hash IS NOT NULL AND NOT framed")
    near = near_hashes(spots.select("type", "hash"), spots.select("type", "hash"), NEAR, by=("type",))
    at = lambda side: spots.select("type", F.col("hash").alias(side), F.col("least").alias(f"core_{side}"))
    alike = near.join(at("a"), ["type", "a"]).join(at("b"), ["type", "b"]).select(F.col("core_a").alias("a"), F.col("core_b").alias("b"))
    same_spot = _stars(loose.select("type", "hash", "core").distinct(), ["type", "hash"], "core")
    groups = components(alike.union(same_spot)).withColumnRenamed("node", "core").withColumnRenamed("root", "family")
    c = stored(c.join(groups, "core", "left").withColumn("family", F.coalesce("family", "core")), "families")
    # loose families beside framed ones: the nearest takes them
    mine = c.where("hash IS NOT NULL AND NOT framed").select("type", "hash", F.col("family").alias("mine")).distinct()
    theirs = c.where("hash IS NOT NULL AND framed").groupBy("type", "hash").agg(F.min("family").alias("theirs"))
    equal = mine.join(theirs, ["type", "hash"]).select("mine", "theirs", F.lit(0).alias("distance"))
    close = near_hashes(mine.select("type", "hash"), theirs.select("type", "hash"), NEAR, by=("type",))
    close = close.join(mine.withColumnRenamed("hash", "a"), ["type", "a"]).join(theirs.withColumnRenamed("hash", "b"), ["type", "b"]).select("mine", "theirs", "distance")
    taken = equal.union(close).groupBy("mine").agg(F.min(F.struct("distance", "theirs")).alias("best"))
    out = c.join(taken, c["family"] == taken["mine"], "left").select("id", F.coalesce("best.theirs", "family").alias("root"))
    return out.groupBy("root").agg(F.min("id").alias("family")).join(out, "root").select("id", "family")


def replication(creatives: DataFrame) -> DataFrame:
    """creatives (product_id, ad_id, active, phash, sha256, source_url, family) -> product_id, distinct_creatives, visual_evidence,
    n_ads, confirmed: whether different pictures run on different active ads of one product (E12).

    Pictures are one concept if their file, address or family is the same or their hashes are within NEAR bits, directly or over others.
    """
    c = creatives.where("active AND phash IS NOT NULL").where(~F.col("phash").isin(*TRIVIAL))
    asset = F.regexp_extract(F.coalesce("source_url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]+)", 1)
    c = stored(c.select("product_id", "ad_id", F.col("phash").alias("hash"), "sha256", F.when(asset != "", asset).alias("asset"), "family"), "pictures")
    nodes = c.select("product_id", "hash").distinct().withColumn("node", F.concat_ws(":", "product_id", "hash"))
    named = c.join(nodes, ["product_id", "hash"])
    links = None
    for key in ("sha256", "asset", "family"):
        part = _stars(named.select("product_id", key, "node").distinct(), ["product_id", key], "node")
        links = part if links is None else links.union(part)
    side = lambda s: nodes.select("product_id", F.col("hash").alias(s), F.col("node").alias(f"node_{s}"))
    near = near_hashes(nodes, nodes, NEAR, by=("product_id",)).join(side("a"), ["product_id", "a"]).join(side("b"), ["product_id", "b"])
    groups = components(links.union(near.select("node_a", "node_b")))
    of = nodes.join(groups, "node", "left").select("product_id", "hash", F.coalesce("root", "node").alias("concept"))
    # counts of distinct values by two small aggregations each: no row is copied for a count
    concepts = of.groupBy("product_id", "concept").agg(F.lit(1)).groupBy("product_id").agg(F.count("*").alias("distinct_creatives"))
    ads = c.groupBy("product_id", "ad_id").agg(F.count("*").alias("n")).groupBy("product_id").agg(F.sum("n").alias("visual_evidence"), F.count("*").alias("n_ads"))
    return concepts.join(ads, "product_id").select("*", ((F.col("distinct_creatives") >= 2) & (F.col("n_ads") >= 2)).alias("confirmed"))


def strongest(video_fp_v2: Column, video_fp: Column, phash: Column) -> Column:
    """The rank of a creative's best evidence in KINDS."""
    return F.when(video_fp_v2.isNotNull(), 3).when(video_fp.isNotNull(), 2).when(phash.isNotNull(), 1).otherwise(0)


def observations(creatives: DataFrame, seen: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """family, ad_id, creative_id, kind, first_seen, last_seen: one row for each family and ad, that of the strongest evidence, then of
    the least creative; times widen over what was known before (A37). Refreshing twice changes nothing.

    creatives (id, ad_id, family, video_fp_v2, video_fp, phash), seen (ad_id, first_seen, last_seen): of each source that reports it.
    """
    rank = strongest(F.col("video_fp_v2"), F.col("video_fp"), F.col("phash"))
    best = creatives.where("family IS NOT NULL").groupBy("family", "ad_id").agg(F.max(F.struct(rank.alias("rank"), (-F.col("id")).alias("last"))).alias("best"))
    times = seen.groupBy("ad_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    now = best.join(times, "ad_id", "left").select("family", "ad_id", (-F.col("best.last")).alias("creative_id"), F.get(F.array(*map(F.lit, KINDS)), F.col("best.rank")).alias("kind"), "first_seen", "last_seen")
    if before is None:
        return now
    value = F.struct("creative_id", "kind")
    both = now.select("*", F.lit(1).alias("new")).unionByName(before.select(*now.columns, F.lit(0).alias("new")))
    out = both.groupBy("family", "ad_id").agg(F.max_by(value, "new").alias("v"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.select("family", "ad_id", "v.*", "first_seen", "last_seen")


def reuse(observed: DataFrame, ads: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """family, ad_count, collation_variants, distinct_pages, distinct_shops, new_pages, earliest: four counts that are never mixed.

    ads (ad_id, page_id, store_id, variants). A page is new if the family's first observation of it is within `days` of now.
    """
    rows = observed.join(ads, "ad_id")
    whole = rows.groupBy("family").agg(F.count("*").alias("ad_count"), F.coalesce(F.sum(F.coalesce("variants", F.lit(1))), F.lit(0)).alias("collation_variants"), F.min("first_seen").alias("earliest"))
    since = now - F.make_dt_interval(F.lit(days))
    pages = rows.where("page_id IS NOT NULL").groupBy("family", "page_id").agg(F.min("first_seen").alias("t")).groupBy("family").agg(F.count("*").alias("distinct_pages"), F.count_if(F.col("t") >= since).alias("new_pages"))
    shops = rows.where("store_id IS NOT NULL").select("family", "store_id").distinct().groupBy("family").agg(F.count("*").alias("distinct_shops"))
    return whole.join(pages, "family", "left").join(shops, "family", "left").na.fill(0, ["distinct_pages", "new_pages", "distinct_shops"])


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as pictures: the signs of 32 numbers are the hash; what else they have comes from id and label."""
    signs = F.expr("aggregate(transform(slice(embedding, 1, 32), (x, i) -> IF(x > 0, shiftleft(1L, i), 0L)), 0L, (s, v) -> s + v)")
    k = F.col("vec_id")
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        k.alias("id"), (k % 97).alias("ad_id"), F.col("label").cast("long").alias("product_id"), (k % 5 > 0).alias("active"), F.when(k % 2 == 0, "video").otherwise("image").alias("type"), signs.alias("phash"), signs.alias("hash"),
        F.when(k % 4 == 0, F.concat(F.lit("s"), (k % 60).cast("string"))).alias("sha256"), F.concat(F.lit("https://cdn.example/"), (k % 150).cast("string"), F.lit("?sig="), k.cast("string")).alias("source_url"),
        F.when(k % 6 == 0, F.concat(F.lit("f"), (k % 90).cast("string"))).alias("video_fp"), F.when(k % 10 == 0, F.lit("v2")).alias("video_fp_v2"), F.when(k % 3 > 0, k % 40).alias("family"),
    )


def _near(spark: SparkSession, sf: str) -> DataFrame:
    p = _pictures(spark, sf)
    pairs = near_hashes(p, p, NEAR, bits=32, bands=3)
    return pairs.where("a < b")


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 97).alias("ad_id"), F.col("ts").alias("first_seen"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("last_seen"))
    return observations(_pictures(spark, sf), seen)


_P = "p AS (SELECT vec_id AS id, vec_id % 97 AS ad_id, label::BIGINT AS product_id, vec_id % 5 > 0 AS active, list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS h FROM embeddings)"
_J12 = f"WITH {_P}, d AS (SELECT DISTINCT h FROM p) SELECT x.h AS a, y.h AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM d x JOIN d y ON x.h < y.h WHERE bit_count(xor(x.h, y.h)) <= 6"
_E12 = f"""
WITH RECURSIVE {_P}, c AS (SELECT *, CASE WHEN id % 4 = 0 THEN id % 60 END AS sha, id % 150 AS asset, CASE WHEN id % 3 > 0 THEN id % 40 END AS family FROM p WHERE active AND h <> 0),
e AS (SELECT DISTINCT x.product_id AS g, x.h AS a, y.h AS b FROM c x JOIN c y ON x.product_id = y.product_id AND (x.sha = y.sha OR x.asset = y.asset OR x.family = y.family OR bit_count(xor(x.h, y.h)) <= 6)),
w AS (SELECT g, a, a AS r FROM e UNION SELECT w.g, w.a, e.b FROM w JOIN e ON e.g = w.g AND e.a = w.r),
k AS (SELECT g, a, min(r) AS r FROM w GROUP BY g, a), n AS (SELECT g, count(DISTINCT r) AS n FROM k GROUP BY g)
SELECT product_id, n AS distinct_creatives, count(*) AS visual_evidence, count(DISTINCT ad_id) AS n_ads, n >= 2 AND count(DISTINCT ad_id) >= 2 AS confirmed FROM c JOIN n ON g = product_id GROUP BY product_id, n
"""
_A37 = """
WITH c AS (SELECT vec_id AS id, vec_id % 97 AS ad_id, vec_id % 40 AS family, CASE WHEN vec_id % 10 = 0 THEN 3 WHEN vec_id % 6 = 0 THEN 2 ELSE 1 END AS r FROM embeddings WHERE vec_id % 3 > 0),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY family, ad_id ORDER BY r DESC, id) = 1),
t AS (SELECT user_id % 97 AS ad_id, min(ts) AS first_seen, max(ts) + INTERVAL 1 DAY AS last_seen FROM events GROUP BY ALL)
SELECT family, ad_id, id AS creative_id, ['same_file', 'poster_phash', 'video_fp_v1', 'video_fp_v2'][r + 1] AS kind, first_seen, last_seen FROM b LEFT JOIN t USING (ad_id)
"""

OPERATORS = [
    Query("j12_banded_hamming", _near, _J12),
    Query("j13_leader_clusters", lambda s, d: led(_pictures(s, d).select("id", "hash"), bits=32, bands=3)),
    Query("e16_creative_families", lambda s, d: families(_pictures(s, d))),
    Query("e12_creative_replication", lambda s, d: replication(_pictures(s, d)), _E12),
    Query("a37_reuse_observations", _observed, _A37),
]
