"""Prices: parsing, currencies, segments, plausibility, landed cost."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars for a unit of each currency (fixed values, used where no rate is given).
USD = {"SAR": 0.27, "AED": 0.27, "KWD": 3.25, "QAR": 0.27, "OMR": 2.6, "BHD": 2.65, "JOD": 1.41, "EGP": 0.021, "IQD": 0.00076, "VND": 0.00004, "THB": 0.028, "PHP": 0.018, "MYR": 0.21, "IDR": 0.000063, "USD": 1, "CAD": 0.73, "GBP": 1.27, "EUR": 1.08, "AUD": 0.65, "NZD": 0.60, "SEK": 0.095, "DKK": 0.145, "CZK": 0.043, "PLN": 0.25, "RON": 0.22, "CNY": 0.14, "RMB": 0.14}
#: How a currency is written before and behind a number (fixed values).
BEFORE = {
    "PHP": ("₱", "PHP", "P"), "SAR": ("SAR", "ر.س"), "AED": ("AED", "د.إ"), "QAR": ("QAR",), "KWD": ("KWD",), "OMR": ("OMR",), "BHD": ("BHD",), "USD": ("US$", "USD", "$"), "EUR": ("€", "EUR"),
    "GBP": ("£", "GBP"), "AUD": ("A$", "AU$", "AUD"), "NZD": ("NZ$", "NZD"), "MYR": ("RM",), "IDR": ("Rp",),
}
BEHIND = {
    "SAR": ("SAR", "ر.س", "ريال"), "AED": ("AED", "د.إ", "درهم"), "QAR": ("QAR",), "KWD": ("KWD",), "OMR": ("OMR",), "BHD": ("BHD",), "PHP": ("PHP",), "VND": ("VND", "VNĐ", "đ", "₫"),
    "USD": ("USD",), "EUR": ("EUR",), "GBP": ("GBP",), "AUD": ("AUD",), "NZD": ("NZD",),
}
#: Units that count only in a context: (times, least number, context) (fixed values).
UNITS = {"k": (1_000, 10, "vietnamese"), "tr": (1_000_000, 0, "money"), "triệu": (1_000_000, 0, "money"), "p": (1, 0, "pesos")}
#: What shows that a text is Vietnamese, that a number counts people or goods, that a text is about money (fixed values).
LETTERS = "ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
TALK = ("giá", "gia ban", "chỉ còn", "đồng", "freeship", "mua ngay")
COUNTED = ("lượt", "khách", "người", "đơn", "follow", "view", "sold", "hạt", "chai", "hộp", "sản phẩm", r"sp\b", "đã bán", "member", "customer", "unit", "pcs")
MONEY = ("giá", "chỉ", "còn", "từ", "trả", "đồng", "vnđ", "₫")
_EDGE = r"[\p{L}\p{N}_"


def _any(words: Iterable[str]) -> str:
    """One group of alternatives, longer ones first, so that US$ is not read as $."""
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _signs(table: dict[str, tuple[str, ...]]) -> list[str]:
    return [re.escape(sign) for signs in table.values() for sign in signs]


def _price_pattern() -> str:
    """Groups: sign and number, or number and sign. A number is digits, then groups of three, then one or two decimals."""
    number, end = r"(\d+(?:[.,]\d{3})*(?:[.,]\d{1,2})?)", f"(?!{_EDGE}%])"
    front = f"({_any(_signs(BEFORE))}) ?{number}{end}"
    back = f"{number} ?({_any([*_signs(BEHIND), *(u for u in UNITS if u != 'p')])}){end}"
    return f"(?iu)(?<!{_EDGE}.]){_any([front])}|(?iu)(?<!{_EDGE}.]){_any([back])}"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def usd(price: Column, currency: Column, rates: dict[str, float] | None = None) -> Column:
    """The price in dollars: no currency is dollars, an unknown one gives null; `rates` come first (F16)."""
    known = _map({k: float(v) for k, v in (USD | (rates or {})).items()})
    return price * F.try_element_at(known, F.upper(F.coalesce(currency, F.lit("USD"))))


def segment(price: Column, currency: Column, rates: dict[str, float] | None = None) -> Column:
    """budget, mid, upper, premium at 15, 35 and 70 dollars; null for no price."""
    x = usd(F.when(price != 0, price), currency, rates)
    return F.when(x < 15, "budget").when(x < 35, "mid").when(x < 70, "upper").when(x.isNotNull(), "premium")


def plausible(price: Column, currency: Column, local: Column, world: tuple[str, ...] = ("USD", "EUR", "GBP")) -> Column:
    """Why a price isn't believed, or null: no price, a currency that is neither the market's nor a world one, under 0.5 or over 5000 dollars."""
    x = usd(price, currency)
    strange = currency.isNotNull() & ~F.upper(currency).isin(*world) & ~F.upper(currency).eqNullSafe(F.upper(local))
    return F.when(price.isNull(), "no price").when(strange, "currency").when(x.isNull(), "unknown currency").when(x < 0.5, "too low").when(x > 5000, "too high")


def landed_cost(price: Column, shipping: Column, vat_included: Column) -> Column:
    """struct(value, missing): price and shipping where both are known and the price has its tax, else what is missing."""
    ok = {"price": price.isNotNull(), "shipping": shipping.isNotNull(), "vat_included": vat_included.eqNullSafe(F.lit(True))}
    missing = F.filter(F.array(*(F.when(~v, k) for k, v in ok.items())), lambda x: x.isNotNull())
    return F.struct(F.when(F.size(missing) == 0, F.round(price + shipping, 2)).alias("value"), missing.alias("missing"))


def parsed_price(text: Column, country: Column | None = None) -> Column:
    """struct(amount, currency) of the first price in a text, or null.

    A unit of UNITS counts in its context alone: thousands in Vietnamese copy, millions where the words around are about money, neither
    before what is counted, a bare P where the country is unknown or the Philippines. Otherwise the text has no price.
    """
    country = F.lit(None).cast("string") if country is None else country
    t = F.coalesce(text, F.lit(""))
    whole, *groups = (F.regexp_extract(t, _price_pattern(), i) for i in range(5))
    number, sign = F.concat(groups[1], groups[2]), F.lower(F.concat(groups[0], groups[3]))
    cents = F.regexp_extract(number, r"[.,](\d{1,2})$", 1)
    units = F.translate(F.when(cents == "", number).otherwise(F.regexp_replace(number, r"[.,]\d{1,2}$", "")), ".,", "")
    value = F.concat_ws(".", units, F.nullif(cents, F.lit(""))).try_cast("double")
    begin = F.position(whole, t)
    behind = F.substring(t, begin + F.length(whole), F.lit(14))
    near = F.concat(F.substring(t, F.greatest(F.lit(1), begin - 14), F.least(begin - 1, F.lit(14))), whole, F.substring(behind, 1, 10))
    goods = behind.rlike(rf"(?iu)^\s*{_any(COUNTED)}")
    talk = t.rlike(f"(?iu)[{LETTERS}]|(?<!{_EDGE}]){_any(TALK)}(?!{_EDGE}])")
    contexts = {"vietnamese": (country.eqNullSafe(F.lit("VN")) | talk) & ~goods, "money": near.rlike(f"(?iu){_any(MONEY)}") & ~goods, "pesos": country.isNull() | country.isin("PH", "ALL")}
    amount = F.when(~sign.isin(*UNITS), value)
    for unit, (times, least, context) in UNITS.items():
        amount = amount.when((sign == unit) & contexts[context] & (value >= least), value * times)
    codes = {sign.lower(): code for table in (BEFORE, BEHIND) for code, signs in table.items() for sign in signs} | {u: "VND" for u in UNITS if u != "p"}
    return F.when((whole != "") & (value > 0) & amount.isNotNull(), F.struct(amount.alias("amount"), F.try_element_at(_map(codes), sign).alias("currency")))
