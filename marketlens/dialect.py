"""Queries as portable SQL. Operators that Spark and other engines spell differently are written as @macros.

`Operator.spark` binds the tables to DataFrames (no global views) and lets Catalyst plan the text; `Operator.other` spells the
same query for DuckDB, where it serves as the check.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from marketlens.sources.store import by_key

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: macro -> (Spark, DuckDB); $1, $2 ... are its arguments.
MACROS = {
    "dayno": ("datediff(CAST($1 AS DATE), DATE '1970-01-01')", "date_diff('day', DATE '1970-01-01', CAST($1 AS DATE))"),
    "micros": ("unix_micros(CAST($1 AS TIMESTAMP))", "epoch_us($1)"),
    "rlike": ("($1 RLIKE $2)", "regexp_matches($1, $2)"),
    "replace_all": ("regexp_replace($1, $2, $3)", "regexp_replace($1, $2, $3, 'g')"),
    "extract": ("regexp_extract($1, $2, $3)", "regexp_extract($1, $2, $3)"),
    "words": ("split($1, ' ')", "string_split($1, ' ')"),
    "split_on": ("split($1, $2)", "string_split($1, $2)"),
    "explode": ("explode($1)", "unnest($1)"),
    "intersect": ("array_intersect($1, $2)", "list_intersect($1, $2)"),
    "list_distinct": ("array_distinct($1)", "list_distinct($1)"),
    "list_sort": ("array_sort($1)", "list_sort($1)"),
    "word_only": (r"regexp_replace(lower($1), '(?U)\\W+', ' ')", r"regexp_replace(lower($1), '[^\p{L}\p{N}_]+', ' ', 'g')"),
    "list_len": ("size($1)", "len($1)"),
    "sorted_join": ("array_join(array_sort(collect_set($1)), ',')", "array_to_string(list_sort(list(DISTINCT $1)), ',')"),
    "sorted_list": ("sort_array(collect_list($1))", "list_sort(list($1))"),
    "item": ("element_at($1, CAST($2 AS INT))", "($1)[CAST($2 AS INT)]"),
    "dot": ("aggregate(zip_with($1, $2, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)", "list_sum(list_transform(list_zip($1, $2), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"),
    "xor": ("($1 ^ $2)", "xor($1, $2)"),
    "unhex": ("CAST(conv($1, 16, 10) AS BIGINT)", "CAST(('0x' || $1) AS BIGINT)"),
    "json_int": ("CAST(get_json_object($1, $2) AS BIGINT)", "CAST(json_extract_string($1, $2) AS BIGINT)"),
    "half_day": ("date_trunc('DAY', $1)", "CAST(date_trunc('day', $1) AS TIMESTAMP)"),
    "week": ("CAST(date_trunc('WEEK', $1) AS DATE)", "CAST(date_trunc('week', $1) AS DATE)"),
    "date": ("CAST($1 AS DATE)", "CAST($1 AS DATE)"),
    "idiv": ("($1 DIV $2)", "($1 // $2)"),
    "str": ("CAST($1 AS STRING)", "CAST($1 AS VARCHAR)"),
    "dbl": ("CAST($1 AS DOUBLE)", "CAST($1 AS DOUBLE)"),
    "kinds": ("CAST(coalesce(bit_count(bit_or(shiftleft(1L, CAST($1 AS INT)))), 0) AS BIGINT)", "CAST(count(DISTINCT $1) AS BIGINT)"),
    "long": ("CAST($1 AS BIGINT)", "CAST($1 AS BIGINT)"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose parenthesis opens at `at`, and the place after it."""
    depth, start, out, quoted = 0, at + 1, [], False
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError(f"unclosed call: {text[at : at + 60]}")


def spell(text: str, which: int) -> str:
    """The text with its macros spelled for engine 0 (Spark) or 1 (DuckDB), from the inside out."""
    while m := list(re.finditer(r"@(\w+)\(", text)):
        call = m[-1]
        args, end = _arguments(text, call.end() - 1)
        body = MACROS[call[1]][which]
        for i, a in enumerate(args, 1):
            body = body.replace(f"${i}", a)
        text = text[: call.start()] + body + text[end:]
    return text


def binary_rounds(text: str) -> str:
    """round(x, digits) by the binary value of x, as DuckDB rounds doubles; Spark's own rounds its shortest decimal text, and a double
    that is a little less than the half it reads as goes up (`functions.rounding.rounded`). All that queries round are doubles."""
    for call in reversed(list(re.finditer(r"\bround\(", text))):
        args, after = _arguments(text, call.end() - 1)
        if len(args) == 2:
            by = f"{10 ** int(args[1])}D"
            text = f"{text[: call.start()]}(round(CAST({args[0]} AS DOUBLE) * {by}, 0) / {by}){text[after:]}"
    return text


@dataclass(frozen=True)
class Operator:
    """One query: an identifier of the inventory, and its SQL over the tables; `check` is what DuckDB runs where it isn't the same, `build`
    what Spark runs where the SQL, taken as it stands, costs pairs of all rows; `dealt` a table and the keys that all windows over it have:
    it comes dealt by them, in partitions that don't grow with it."""

    name: str
    sql: str
    check: str = ""
    build: Callable[[SparkSession, str], DataFrame] | None = None
    dealt: tuple[str, tuple[str, ...]] | None = None

    def tables(self) -> list[str]:
        return [t for t in TABLES if re.search(rf"\b{t}\b", self.sql)]

    def spark(self, session: SparkSession, sf_dir: str) -> DataFrame:
        if self.build:
            return self.build(session, sf_dir)
        text = binary_rounds(spell(self.sql, 0)).replace("{", "{{").replace("}", "}}")
        text = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b", lambda m: f"{m[1]} {{{m[2]}}}", text)
        tables = {t: session.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables() if f"{{{t}}}" in text}
        if self.dealt:
            tables[self.dealt[0]] = by_key(tables[self.dealt[0]], *self.dealt[1])
        return session.sql(text, **tables)

    def other(self) -> str:
        return spell(self.check or self.sql, 1)


@dataclass(frozen=True)
class Query:
    """One query built from DataFrame functions, and the SQL written for it apart from them ('' where SQL can't express it)."""

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    check: str = ""

    def spark(self, session: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(session, sf_dir)

    def other(self) -> str:
        return self.check
