"""Text normalisers, tokenizers and keys, as Column expressions inside whole-stage code.

Null texts count as empty. Texts are taken as composed (NFC): Spark has no normaliser, and a Python one would leave the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.rounding import once, rounded


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letters they decompose to, from the character database."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
        if len(base) == 1:
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _plain_letters()


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold(c: Column | str) -> Column:
    """Small letters, punctuation but ' and - to one space, tones kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_text(c)), r"(?U)[^\w\s'-]", " "), r"(?U)\s+", " "))


def fold_ascii(c: Column | str) -> Column:
    """Small ASCII letters: accents stripped, ß as ss, the rest beyond ASCII dropped."""
    bare = F.translate(F.replace(_text(c), F.lit("ß"), F.lit("ss")), ACCENTED, BARE)
    return F.lower(F.regexp_replace(bare, r"[^\x00-\x7F]", ""))


def normal_copy(c: Column | str, length: int = 150) -> Column:
    """A key of an advertisement's copy: no accents, word characters with single spaces, the first `length` characters."""
    bare = F.translate(F.lower(_text(c)), ACCENTED.lower(), BARE.lower())
    return F.substring(F.trim(F.regexp_replace(bare, r"(?U)\W+", " ")), 1, length)


def squash(c: Column | str, length: int = 120) -> Column:
    """Word characters alone, the first `length`."""
    return F.substring(F.regexp_replace(F.lower(_text(c)), r"(?U)\W+", ""), 1, length)


def ascii_tokens(c: Column | str, least: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct runs of a-z and 0-9 of the folded text with `least` characters or more."""
    found = F.array_distinct(F.regexp_extract_all(fold_ascii(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stop) if stop else F.length(t) >= least)


def letter_tokens(c: Column | str, least: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct runs of `least` letters or more of any script."""
    found = F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"(\p{L}{%d,})" % least), F.lit(1)))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def name_tokens(c: Column | str, synonyms: Column | None = None, stop: tuple[str, ...] = ()) -> Column:
    """Tokens of a product name: numbers dropped, synonyms (a map column) applied, stop words dropped, plain plurals folded."""
    words = F.split(F.trim(F.regexp_replace(F.lower(_text(c)), r"(?U)[^\w\s]+|\s+", " ")), r"\s+")
    words = F.filter(words, lambda t: (t != "") & ~t.rlike(r"^\d+$"))
    if synonyms is not None:
        words = F.transform(words, lambda t: F.coalesce(F.try_element_at(synonyms, t), t))
    if stop:
        words = F.filter(words, lambda t: ~t.isin(*stop))
    return F.transform(words, lambda t: F.when((F.length(t) > 4) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def title_key(title: Column | str, brand: Column | str, stop: tuple[str, ...] = ()) -> Column:
    """brand|sorted tokens of two characters or more; null with fewer than two tokens."""
    tokens = F.array_sort(ascii_tokens(title, 2, stop))
    b = F.regexp_replace(fold_ascii(brand), "[^a-z0-9]", "")
    body = F.substring(F.array_join(tokens, " "), 1, 240)
    return F.when(F.size(tokens) >= 2, F.concat(F.when(b != "", F.concat(b, F.lit("|"))).otherwise(""), body))


def split_keywords(c: Column | str) -> Column:
    """'a | b, c' -> distinct trimmed small keywords in order."""
    parts = F.transform(F.split(F.lower(_text(c)), r"[|,\n;]"), lambda k: F.trim(k))
    return F.array_distinct(F.filter(parts, lambda k: k != ""))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_text(c), F.lit(r"[\p{L}\p{M}']+"))


def reliability(words: Column, lang: Column, read: tuple[str, ...] = ("en", "vi", "tl", "ar"), enough: int = 12, least: int = 3) -> Column:
    """How far rules may trust a text: words / enough, halved for a language they can't read, 0.6 without a language."""
    factor = F.when(lang.isin(*read), 1.0).when(lang != "und", 0.5).otherwise(0.6)
    return F.when(words < least, 0.0).otherwise(rounded(F.least(F.lit(1.0), words / enough) * factor, 3))


def needs_text(rel: Column, lang: Column, read: tuple[str, ...] = ("en", "vi", "tl", "ar"), bar: float = 0.5) -> Column:
    return (rel < bar) & lang.isin(*read, "und")  # P30


def detected_language(c: Column | str, scripts: dict[str, str], words: dict[str, tuple[str, ...]], marks: dict[str, str], share: float = 0.3, marked: float = 0.12) -> Column:
    """Share of a script's letters, then of a language's marks, then the most function words; 'und' for fewer than three words."""
    t = _text(c)
    letters = F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"\p{L}")))
    tokens = F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{M}']+)"), F.lit(1))
    counted = once(tokens, lambda w: F.array(F.size(w), *(_hits(w, own) for own in words.values())))
    return once(F.struct(letters.alias("letters"), counted.alias("counts")), lambda f: _language(t, f["letters"], f["counts"], scripts, list(words), marks, share, marked))


def _language(t: Column, letters: Column, counted: Column, scripts: dict[str, str], words: list[str], marks: dict[str, str], share: float, marked: float) -> Column:
    out = None
    for code, chars in scripts.items():
        hit = F.regexp_count(t, F.lit(chars)) / letters >= share
        out = F.when(hit, code) if out is None else out.when(hit, code)
    few = counted[0] < 3
    out = F.when(few, "und") if out is None else out.when(few, "und")
    for code, chars in marks.items():
        out = out.when(F.regexp_count(F.lower(t), F.lit(chars)) / letters >= marked, code)
    counts = {code: counted[i] for i, code in enumerate(words, 1)}
    most = F.greatest(*counts.values()) if len(counts) > 1 else next(iter(counts.values()))
    out = out.when(most == 0, "und")
    for code, n in counts.items():
        out = out.when(n == most, code)
    return out


def _hits(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*words)))


def host(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def plain_url(url: Column | str) -> Column:
    """scheme://host/path without www., query, fragment and closing slashes."""
    u = _text(url)
    scheme = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(F.when(scheme == "", "https").otherwise(F.lower(scheme)), F.lit("://"), host(url), path)


def without_parameters(url: Column | str, names: str = r"utm_[a-z]+|fbclid|gclid|ref") -> Column:
    """The address without tracking parameters."""
    u = F.regexp_replace(_text(url), r"(?<=[?&])(?:" + names + r")=[^&#]*&?", "")
    return F.regexp_replace(u, r"[?&]+(?=#|$)", "")


def slug_tokens(url: Column | str) -> Column:
    """Tokens of the path of an address."""
    path = F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.array_distinct(name_tokens(F.regexp_replace(path, "[-_/]", " ")))


def cross_source_key(advertiser: Column, copy: Column, url: Column) -> Column:
    """One key for one creative whoever reports it; null without copy and address."""
    place = F.regexp_extract(_text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    key = F.substring(F.sha1(F.concat_ws("|", F.lower(_text(advertiser)), squash(copy), place)), 1, 16)
    return F.when((_text(copy) != "") | (_text(url) != ""), key)


def parsed_time(c: Column | str) -> Column:
    """The first of five formats that fits: with and without fractions, a blank, a day, a day with slashes."""
    t = F.replace(F.trim(_text(c)), F.lit("Z"), F.lit(""))
    formats = ("yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in formats))


def scrubbed(c: Column | str, keys: str = "token|secret|password|api_key|access_token|authorization") -> Column:
    """Secret values of JSON fields and of address parameters are masked."""
    t = F.regexp_replace(_text(c), r'(?i)("(?:' + keys + r')"\s*:\s*)"[^"]*"', '$1"***"')
    return F.regexp_replace(t, r"(?i)([?&](?:" + keys + r")=)[^&#\s\"]*", "$1***")
