"""Search over texts: keywords in tiers, exclusions, expansion limits, relevance, facets.

Every function takes a DataFrame and arguments; literals reach the scan as filters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The beginning of a text, or anything that belongs to no word: a blank, a line break, a bracket.
BEGINS = r"(?:^|[^\p{L}\p{M}\p{N}_])"


def has_term(c: Column, term: str) -> Column:
    """A short ASCII term must begin a word; others may stand anywhere."""
    term = term.lower()
    return c.rlike(BEGINS + re.escape(term)) if len(term) <= 4 and term.isascii() else F.contains(c, F.lit(term))


def has_all(c: Column, keyword: str) -> Column:
    """Every word of the keyword."""
    out = F.lit(True)
    for word in keyword.lower().split():
        out = out & has_term(c, word)
    return out


def tier(c: Column, keyword: str, synonyms: list[list[str]] = (), avoid: list[str] = (), related: list[str] = ()) -> Column:
    """0 exact; 1 every group of synonyms hit and nothing to avoid; 2 a related term; else null."""
    either = lambda terms: F.greatest(*(has_term(c, t) for t in terms), F.lit(False))
    groups = F.lit(bool(synonyms))
    for group in synonyms:
        groups = groups & either(group)
    if avoid:
        groups = groups & ~either(avoid)
    return F.when(has_all(c, keyword), 0).when(groups, 1).when(either(related) if related else F.lit(False), 2)


def search(rows: DataFrame, column: str, keywords: list[str], synonyms: dict[str, list[list[str]]] | None = None, related: dict[str, list[str]] | None = None, exclude: list[str] = (), enough: int = 30, where: Column | None = None) -> DataFrame:
    """rows with tier and n_strong: hits of any keyword without excluded words; related hits only while fewer than `enough` strong ones
    are there (P17). One scan of the text; the count of strong hits is one row that joins back."""
    c = F.lower(F.coalesce(F.col(column), F.lit("")))
    kept = rows if where is None else rows.where(where)
    for word in exclude:
        kept = kept.where(~F.contains(c, F.lit(word.lower())))
    tiers = [tier(c, k, (synonyms or {}).get(k, []), related=(related or {}).get(k, [])) for k in keywords]
    best = F.least(*tiers, F.lit(9)) if tiers else F.lit(9)
    strong = sum((F.when(t < 2, 1).otherwise(0) for t in tiers), F.lit(0))
    hits = kept.withColumn("tier", best).withColumn("n_strong", strong).where("tier < 9")
    total = hits.agg(F.count_if(F.col("tier") < 2).alias("_strong"))
    return hits.join(F.broadcast(total), F.lit(True)).where((F.col("tier") < 2) | (F.col("_strong") < enough)).drop("_strong")


def by_relevance(hits: DataFrame, then: list[Column]) -> list[Column]:
    """The order of results: most strong keywords, best tier, then what was asked for."""
    return [F.desc("n_strong"), F.asc("tier"), *then]


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n for several columns from one pass."""
    sets = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f"))
    return sets.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)
