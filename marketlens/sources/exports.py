"""Exports of advertisements: CSV, JSON and XML files with headers of any spelling, read in full or watched as a stream.

A record keeps its whole source row as JSON, so nothing an alias misses is lost. Records that miss a required field go to
the quarantine with their reasons instead of stopping the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Field -> spellings of its header, compared without case and punctuation. Callers pass their own where these don't fit.
ALIASES = {
    "external_id": ["external_id", "ad_id", "id", "ad archive id"],
    "advertiser": ["advertiser", "page_name", "brand", "seller"],
    "ad_text": ["ad_text", "text", "body", "caption", "copy"],
    "title": ["title", "headline", "name"],
    "landing_page": ["landing_page", "url", "link", "destination"],
    "country": ["country", "market", "region"],
    "first_seen": ["first_seen", "start_date", "created_at", "date"],
    "last_seen": ["last_seen", "end_date", "updated_at"],
    "price": ["price", "amount"],
    "currency": ["currency"],
}
REQUIRED = ("external_id", "advertiser")


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def mapped(rows: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """One column for each field: the first header that is one of its spellings, blank values as null; raw holds the row."""
    found = {_plain(c): c for c in reversed(rows.columns)}
    columns = []
    for field, names in (aliases or ALIASES).items():
        own = [f"`{found[_plain(n)]}`" for n in names if _plain(n) in found]
        values = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in own]
        columns.append((F.coalesce(*values) if values else F.lit(None).cast("string")).alias(field))
    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))) if rows.columns else F.lit("{}")
    return rows.select(*columns, raw.alias("raw"))


def read_export(spark: SparkSession, path: str, aliases: dict[str, list[str]] | None = None, row_tag: str = "row") -> DataFrame:
    """An export by the ending of its path: .json and .jsonl, .xml, else CSV with a header."""
    kind = path.rstrip("/*").lower()
    if kind.endswith((".jsonl", ".ndjson")):
        rows = spark.read.json(path)
    elif kind.endswith(".json"):
        rows = spark.read.option("multiLine", True).json(path)
    elif kind.endswith(".xml"):
        rows = spark.read.format("xml").option("rowTag", row_tag).load(path)
    else:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return mapped(rows, aliases)


def watch_folder(spark: SparkSession, folder: str, schema: StructType | str, aliases: dict[str, list[str]] | None = None, files: int = 100) -> DataFrame:
    """New CSV files of a folder as a stream of mapped records."""
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(folder)
    return mapped(rows, aliases)


def reasons(required: tuple[str, ...] = REQUIRED, allowed: dict[str, tuple[str, ...]] | None = None) -> Column:
    """What is wrong with a record: missing required fields, values outside a list (P25)."""
    checks = [F.when(F.col(f).isNull(), f"missing {f}") for f in required]
    checks += [F.when(F.col(f).isNotNull() & ~F.col(f).isin(*values), f"value of {f}") for f, values in (allowed or {}).items()]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validated(records: DataFrame, required: tuple[str, ...] = REQUIRED, allowed: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good records, quarantined ones with a column reasons)."""
    checked = records.withColumn("reasons", reasons(required, allowed))
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def json_field_map(rows: DataFrame, column: str, fields: dict[str, list[str]]) -> DataFrame:
    """Fields of JSON documents by the first path that has a value, such as $.snapshot.body.text."""
    first = lambda paths: F.coalesce(*(F.nullif(F.get_json_object(column, p), F.lit("")) for p in paths))
    return rows.select(*(first(paths).alias(name) for name, paths in fields.items()), F.col(column).alias("raw"))
