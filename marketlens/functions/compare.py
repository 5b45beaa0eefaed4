"""Comparisons of titles, identities, prices, hashes and vectors."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 where one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts, which no built-in function has (F28); for finalists, not for all pairs."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, s or "", t or "").ratio() for s, t in zip(x, y)], dtype=float)

    return F.pandas_udf(ratio, "double")(a, b)


def title_similarity(a: Column, b: Column, sequence: Column | None = None) -> Column:
    """0.4 jaccard, 0.35 containment (halved for names of one or two tokens), 0.25 sequence ratio of the sorted tokens."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    contain = containment(a, b) * F.when(F.least(F.size(a), F.size(b)) <= 2, 0.5).otherwise(1.0)
    if sequence is None:
        sequence = sequence_ratio(F.array_join(F.array_sort(a), " "), F.array_join(F.array_sort(b), " "))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 0.4 * jaccard(a, b) + 0.35 * contain + 0.25 * sequence).otherwise(0.0)


def price_similarity(a: Column, b: Column) -> Column:
    """The smaller over the larger price; null where one is missing or 0."""
    return F.when((a != 0) & (b != 0), F.least(a, b) / F.greatest(a, b))


def valid_gtin(c: Column) -> Column:
    """8, 12, 13 or 14 digits with a right check digit, weights 3 and 1 from the right."""
    d = F.split(F.reverse(F.substring(c, F.lit(1), F.length(c) - 1)), "")
    total = F.aggregate(d, F.struct(F.lit(0).alias("s"), F.lit(3).alias("w")), lambda a, x: F.struct((a["s"] + a["w"] * F.coalesce(x.try_cast("int"), F.lit(0))).alias("s"), (4 - a["w"]).alias("w")), lambda a: a["s"])
    return c.rlike(r"^(?:\d{8}|\d{12,14})$") & ~c.rlike("^0+$") & ((10 - total % 10) % 10 == F.substring(c, -1, 1).try_cast("int"))


def identity_match(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """True: same valid gtin, or brand and same sku. False: gtin, brand, model or, with a brand, sku differ. Null: can't tell."""
    norm = lambda c: F.trim(F.lower(c))
    has = lambda k: F.coalesce((left[k] != "") & (right[k] != ""), F.lit(False))
    differ = F.lit(False)
    for k in ("gtin", "brand", "model"):
        differ = differ | (has(k) & (norm(left[k]) != norm(right[k])))
    return F.when(differ, False).when(has("gtin") & valid_gtin(left["gtin"]), True).when(has("brand") & has("sku"), norm(left["sku"]) == norm(right["sku"]))


def numeric_models(c: Column) -> Column:
    """Tokens that hold digits, such as model numbers and sizes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\b(?:[a-z]+-?)?\d+[a-z]*\b)"), F.lit(1)))


def compatible_titles(query: Column, title: Column) -> Column:
    """Every model number of the query is in the title."""
    return F.size(F.array_except(numeric_models(query), numeric_models(title))) == 0


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def clamped(cos: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos - low) / (high - low)))


def same_video(a: Column, b: Column, most: int = 10) -> Column:
    """Whether all frames that both fingerprints (arrays of hashes, null where unusable) have differ in `most` bits at most; null
    with fewer than two such frames (F35)."""
    near = F.filter(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), lambda d: d.isNotNull())
    return F.when(F.size(near) >= 2, F.forall(near, lambda d: d <= most))
