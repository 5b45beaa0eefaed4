"""PII: format-preserving Feistel pseudonyms for validated numbers and dates, in SQL expressions alone.

A pattern finds candidates in the whole text; each is validated (card numbers by their check digit, IBANs by their remainder,
IPv4 octets, calendar dates, social security ranges) and permuted within its format by a keyed Feistel network, so equal
values get equal pseudonyms in all documents and different values different ones. What isn't valid stays as it is. Also
permuted are phone numbers, the name part of mail addresses and secret hexadecimal tokens, character by character.

Defined cases: null texts stay null, empty ones empty; a value found twice gets the same pseudonym; overlapping candidates
are taken from the left; repeated rows have equal results; an empty table gives an empty result. Long texts are read whole:
every part of a pattern has a bounded length or is possessive, so near misses cost a bounded search at each place and no
deep recursion. A mail name has 64 characters at most, a domain 127 labels of 63.

Not found: IBANs printed in groups, dates other than yyyy-mm-dd of 1900 to 2099, phone numbers without '+', mail names with
letters beyond ASCII, and a valid card straight after another number. Mail domains stay readable. IBANs whose check digits
are 00, 01 or 99 aren't valid (the standard has 02 to 98), so that two IBANs never get one pseudonym.

The key is an argument; session_key() takes it from the session's setting KEY_SETTING, which Spark redacts in its listings,
and draws a random one for the session where it is unset.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import fresh

KEY_SETTING, ROUNDS, WALK = "spark.marketlens.pseudonym.secret", 8, 40
_B, _E = r"(?<![\p{L}\p{N}])(?<![0-9][.\-])", r"(?![\p{L}\p{N}])"
#: Alternatives in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}+(?<=[A-Za-z0-9])@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]{0,62}[A-Za-z0-9]){1,126}+",
    "secret": r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})" + _E,
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}" + _E,
    "date": r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}" + _E,
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + r"(?!\.?[0-9])" + _E,
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])" + _E,
    "phone": r"\+[0-9]{1,3}[ \-]?\(?[0-9]{2,4}\)?[ \-]?[0-9]{2,4}[ \-]?[0-9]{3,4}(?!-?[0-9])" + _E,
    "card": r"[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?!-?[0-9])" + _E,
}
UNION = _B + "(?:" + "|".join(PATTERNS.values()) + ")"
#: Quick test: what no candidate can do without (a mail sign, seven digits of a number with separators, a token's first 32 digits,
#: or the shapes of an address and of an IBAN, which can have fewer digits).
QUICK = r"@|[0-9](?:[ .()\-]{0,2}[0-9]){6}|[0-9a-fA-F]{32}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def session_key(spark: SparkSession) -> str:
    """The session's key for pseudonyms: equal values link wherever the same key was used."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def _hash(key: str, kind: Column | str, *parts: Column) -> Column:
    """52 bits of a keyed digest."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, *(p.cast("string") for p in parts)), 256), 1, 13), 16, 10).cast("long")


def permuted(x: Column, n: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0..n-1: Feistel rounds on a grid of a by b cells, walking on while the cell lies beyond n."""
    from math import isqrt

    a = isqrt(n - 1) + 1
    b = -(-n // a)
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")

    def once(v: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            moved = F.when(even, F.pmod(s["x"] + _hash(key, kind, i, s["y"]), la)).otherwise(F.pmod(s["y"] + _hash(key, kind, i, s["x"]), lb))
            return F.struct(F.when(even, moved).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(moved).alias("y"))

        start = F.struct(F.pmod(v, la).alias("x"), F.floor(v / la).cast("long").alias("y"))
        return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn, lambda s: s["x"] + s["y"] * la)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def respelled(value: Column, key: str, kind: str) -> Column:
    """Digits to digits, small letters to small, capitals to capitals; all else stays.

    A Feistel network over the characters: halves take turns, and each character moves within its alphabet by a digest of
    the other half, of the round and of its place.
    """
    half = F.floor(F.length(value) / 2).cast("int")

    def moved(part: Column, other: Column, i: Column) -> Column:
        chars = F.split(part, "")

        def step(c: Column, at: Column) -> Column:
            out = c
            for alphabet in (_DIGITS, _LOWER, _UPPER):
                pos = F.when(c != "", F.instr(F.lit(alphabet), c)).otherwise(0)
                shifted = F.pmod(pos - 1 + _hash(key, kind, i, at, other), F.lit(len(alphabet))).cast("int") + 1
                out = F.when(pos > 0, F.substring(F.lit(alphabet), shifted, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(chars, step), "")

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], i)).alias("r"))

    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn, lambda s: F.concat(s["l"], s["r"]))


def luhn_sum(digits: Column) -> Column:
    """Sum of the check over a string of digits, the last not doubled."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN with its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.when(c.rlike("[0-9]"), c).cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _refilled(pattern: Column, digits: Column) -> Column:
    """pattern with its digits replaced, one after another, by those of `digits`."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda t, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(t["s"], F.substring(digits, t["k"], F.lit(1))).alias("s"), (t["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(t["s"], c).alias("s"), t["k"].alias("k")))
    return F.aggregate(F.split(pattern, ""), start, step, lambda t: t["s"])


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of a candidate that UNION found; the candidate itself where it isn't valid."""
    full = lambda name: v.rlike("^(?:" + PATTERNS[name].replace(_E, "") + ")$")
    digits = F.regexp_replace(v, "[^0-9]", "")
    email = F.concat(respelled(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))
    # cards: all digits but the last are permuted, and the last makes the check sum right again
    body = respelled(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when((luhn_sum(digits) % 10 == 0) & F.length(digits).between(13, 19), _refilled(v, F.concat(body, check)))
    base = F.concat(F.substring(v, 1, 2), F.lit("00"), respelled(F.substring(v, F.lit(5), F.length(v)), key, "iban"))
    iban = F.when((mod97(v) == 1) & ~F.substring(v, 3, 2).isin("00", "01", "99"), F.concat(F.substring(v, 1, 2), F.lpad((98 - mod97(base)).cast("string"), 2, "0"), F.substring(base, F.lit(5), F.length(v))))
    first, days = "1900-01-01", 73_414  # up to 2100-12-31
    day = F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).cast("date")
    date = F.when(day.isNotNull(), F.date_format(F.date_add(F.lit(first).cast("date"), permuted(F.datediff(day, F.lit(first).cast("date")), days, key, "date").cast("int")), "yyyy-MM-dd"))
    octets = F.transform(F.split(v, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    moved = permuted(number, 1 << 32, key, "ip")
    ip = F.when(F.forall(octets, lambda o: o < 256), F.concat_ws(".", *(F.shiftright(moved, 8 * k).bitwiseAND(255).cast("string") for k in (3, 2, 1, 0))))
    area, group, serial = (F.substring(digits, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = ((area - F.when(area > 666, 2).otherwise(1)).cast("long") * 99 + group - 1) * 9999 + serial - 1
    to = permuted(F.when(valid, place).otherwise(0), 898 * 99 * 9999, key, "ssn")
    new_area = F.floor(to / F.lit(99 * 9999)).cast("int") + 1
    ssn = F.when(valid, F.format_string("%03d-%02d-%04d", new_area + F.when(new_area > 665, 1).otherwise(0), (F.floor(to / F.lit(9999)) % 99 + 1).cast("int"), (to % 9999 + 1).cast("int")))
    head = F.regexp_extract(v, r"^\+[0-9]{1,3}", 0)
    phone = F.concat(head, respelled(F.substring(v, F.length(head) + 1, F.length(v)), key, "phone"))
    secret = F.when(v.rlike("[0-9]") & v.rlike("[a-fA-F]"), _hex(v, key))
    ladder = F.when(v.contains("@"), email)
    for name, made in (("secret", secret), ("iban", iban), ("date", date), ("ip", ip), ("ssn", ssn), ("phone", phone), ("card", card)):
        ladder = ladder.when(full(name), made)
    return F.coalesce(ladder, v)


def _hex(v: Column, key: str) -> Column:
    """Hexadecimal digits to hexadecimal digits in the case of the value: Feistel over halves of at most 32 digits."""
    low = F.lower(v)
    half = F.floor(F.length(low) / 2).cast("int")
    mask = lambda part, other, i: F.array_join(
        F.transform(F.split(part, ""), lambda c, at: F.lower(F.hex(F.pmod(F.conv(c, 16, 10).cast("long") + _hash(key, "hex", i, at, other), F.lit(16))))), "")
    turn = lambda s, i: F.struct(F.when(i % 2 == 0, mask(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, s["r"]).otherwise(mask(s["r"], s["l"], i)).alias("r"))
    start = F.struct(F.substring(low, F.lit(1), half).alias("l"), F.substring(low, half + 1, F.length(low)).alias("r"))
    out = F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, turn, lambda s: F.concat(s["l"], s["r"]))
    return F.when(v == low, out).otherwise(F.upper(out))


def masked(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the values in the text replaced by pseudonyms; documents without any candidate pass at the cost of one search."""
    columns = docs.columns
    found, gaps = fresh("_pii_found", columns), fresh("_pii_gaps", columns)
    t = F.col(text)
    has = t.rlike(QUICK)
    rows = docs.withColumn(found, F.when(has, F.regexp_extract_all(t, F.lit("(" + UNION + ")"), F.lit(1)))).withColumn(gaps, F.when(has & (F.size(found) > 0), F.split(t, UNION)))
    new = F.transform(F.col(found), lambda v: pseudonym(v, key))
    woven = F.array_join(F.flatten(F.zip_with(F.col(gaps), F.concat(new, F.array(F.lit(""))), lambda g, v: F.array(g, v))), "")
    return rows.withColumn(text, F.when(F.col(gaps).isNotNull(), woven).otherwise(t)).select(*columns)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, changed."""
    before = fresh("_before", docs.columns)
    out = masked(docs.select("doc_id", "text", F.col("text").alias(before)), key)
    return out.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col(before))).alias("changed"))
