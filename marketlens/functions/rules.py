"""Normalisers of scores, labels and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.rounding import once, rounded

#: Pattern, weight and name of what makes an advertisement risky (fixed values).
RISKS = [
    (r"\b(replica|1:1|aaa\+?|super ?fake|mirror quality|master copy|first copy|rep)\b|hàng fake|hàng nhái|like auth", 45, "counterfeit"),
    (r"\b(rolex|cartier|louis vuitton|lv|gucci|chanel|dior|hermes|hermès|prada|van cleef|bvlgari|tiffany|apple watch|airpods|dyson)\b", 25, "brand"),
    (r"chữa (khỏi|dứt điểm)|trị dứt|\bcures?\b|(?<!semi[ -])\bcured\b|100% (hiệu quả|effective)|guaranteed results|cam kết khỏi|يعالج نهائيا", 35, "medical_claim"),
    (r"giảm \d+ ?kg|lose \d+ ?(kg|lbs|pounds)|weight loss in \d+ days|tan mỡ cấp tốc", 30, "weight_loss_claim"),
    (r"\b(viagra|cialis|sex|tăng size|enlarge(ment)?|kéo dài thời gian)\b", 35, "adult"),
    (r"\b(air gun|pistol|firearm|rifle|vape|cbd|thc|nicotine|e-?cig)\b|thuốc lá điện tử", 40, "restricted"),
    (r"before\s*/?\s*after|trước và sau", 10, "before_after"),
]
_TOOLS = r"\b(massage|fascia|glue|nail|heat|spray|paint|tattoo|caulk|staple|grease) guns?\b"
_CHEAP = r"giá rẻ|cheap|\$\d{1,2}\b|99k|49k"


def linear(x: Column, low: float, high: float) -> Column:
    """0 to 100 between two bounds; 50 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - low) / (high - low) * 100)), F.lit(50.0))


def logarithmic(x: Column, low: float, high: float) -> Column:
    import math

    return linear(F.log1p(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))), math.log1p(low), math.log1p(high))


def weighted(parts: dict[str, tuple[float, Column]]) -> Column:
    """struct(value, breakdown): the weighted mean of parts and the parts themselves, rounded to one place."""
    total = sum(w for w, _ in parts.values())
    value = sum((w * v for w, v in parts.values()), F.lit(0.0)) / total
    return F.struct(value.alias("value"), F.struct(*(F.round(v, 1).alias(k) for k, (_, v) in parts.items())).alias("breakdown"))


def freshness(age_hours: Column) -> Column:
    return F.when(age_hours < 1, "fresh").when(age_hours < 6, "recent").when(age_hours < 24, "stale").otherwise("unreliable")


def trend(new: Column, before: Column) -> Column:
    """struct(arrow, growth)."""
    g = F.when(before != 0, F.try_divide(new, before) - 1)
    arrow = F.when(g >= 1, "↑↑↑").when(g >= 0.4, "↑↑").when(g >= 0.1, "↑").when(g <= -0.5, "↓↓").when(g <= -0.1, "↓").when(g.isNotNull(), "→").when(new != 0, "NEW").otherwise("–")
    return F.struct(arrow.alias("arrow"), rounded(g, 3).alias("growth"))


def sentiment_of_stars(stars: Column) -> Column:
    return F.when(stars >= 4, "positive").when(stars <= 2, "negative").when(stars.isNotNull(), "neutral")  # F18


def page_age(published: Column, first_video: Column, most: int = 14) -> Column:
    """struct(days_older, flag): a landing page much older than the first video."""
    days = F.datediff(first_video, published)
    return F.struct(days.alias("days_older"), F.coalesce(days > most, F.lit(False)).alias("flag"))


def compliance_risk(text: Column) -> Column:
    """struct(risk, flags): the weights of the patterns that a text shows, 100 at most; a cheap luxury brand adds 20."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _TOOLS, " ")
    return once(once(t, lambda x: F.array(*(x.rlike("(?iu)" + p) for p, _, _ in RISKS), x.rlike(_CHEAP))), _judged)


def _judged(shown: Column) -> Column:
    hit = {name: shown[i] for i, (_, _, name) in enumerate(RISKS)}
    cheap = hit["brand"] & ~hit["counterfeit"] & shown[len(RISKS)]
    score = sum((F.when(hit[name], w).otherwise(0) for _, w, name in RISKS), F.lit(0)) + F.when(cheap, 20).otherwise(0)
    flags = F.filter(F.array(*(F.when(h, n) for n, h in hit.items()), F.when(cheap, "cheap_luxury")), lambda x: x.isNotNull())
    return F.struct(F.least(F.lit(100), score).alias("risk"), flags.alias("flags"))


def win_label(win: Column) -> Column:
    return F.when(win >= 75, "Likely Winner").when(win >= 60, "Potential Winner").when(win >= 45, "Mixed Signals").otherwise("Weak Signals")


def backoff(tries: Column) -> Column:
    """Seconds to wait after so many failures, an hour at most."""
    return F.least(F.lit(3600), F.lit(60) * F.pow(F.lit(2), tries - 1)).cast("long")
