"""Feeds: reference rates of currencies as XML, stored pages, public posts named in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rates(spark: SparkSession, path: str) -> DataFrame:
    """day, currency, rate (units for one euro) of a feed of dated Cube elements with their own namespace.

    The file is text to Spark: each line or element that names a currency and a rate is one row.
    """
    whole = spark.read.option("wholetext", True).text(path)
    days = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<Cube[^>]*time=.*?</Cube>)"), F.lit(1))).alias("day"))
    item = F.explode(F.regexp_extract_all("day", F.lit(r"(<Cube[^>]*currency=[^>]*>)"), F.lit(1)))
    rows = days.select(F.regexp_extract("day", r"""time=["'](\d{4}-\d{2}-\d{2})""", 1).cast("date").alias("day"), item.alias("item"))
    return rows.select("day", F.regexp_extract("item", r"""currency=["']([A-Z]{3})""", 1).alias("currency"), F.regexp_extract("item", r"""rate=["']([0-9.]+)""", 1).try_cast("double").alias("rate")).where("rate > 0")


def landing_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, price, currency and rating that a stored page's markup states: meta properties first, then its JSON block."""
    meta = lambda name: F.nullif(F.regexp_extract(html, r"""(?is)<meta[^>]*(?:property|name)=["']%s["'][^>]*content=["']([^"']*)""" % name, 1), F.lit(""))
    block = F.regexp_extract(html, r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>""", 1)
    field = lambda name: F.nullif(F.regexp_extract(block, r'"%s"\s*:\s*"?([^",}\]]+)' % name, 1), F.lit(""))
    title = F.coalesce(meta("og:title"), F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))
    return pages.select("*", title.alias("title"), F.coalesce(meta("product:price:amount"), field("price")).try_cast("double").alias("price"), F.coalesce(meta("product:price:currency"), field("priceCurrency")).alias("currency"), field("ratingValue").try_cast("double").alias("rating"))


#: Platform -> pattern of a public post's address, whose group is the post's id (fixed values).
POSTS = {"tiktok": r"tiktok\.com/@[\w.]+/video/(\d+)", "instagram": r"instagram\.com/(?:p|reel)/([\w-]+)", "youtube": r"(?:youtube\.com/(?:watch\?v=|shorts/)|youtu\.be/)([\w-]{11})", "facebook": r"facebook\.com/[\w.]+/(?:posts|videos)/(\d+)"}


def post_reference(fields: list[str]) -> Column:
    """struct(platform, post_id, field) of the first field that names a public post, else null."""
    found = [F.when(F.regexp_extract(F.col(f), p, 1) != "", F.struct(F.lit(name).alias("platform"), F.regexp_extract(F.col(f), p, 1).alias("post_id"), F.lit(f).alias("field"))) for f in fields for name, p in POSTS.items()]
    return F.coalesce(*found)
