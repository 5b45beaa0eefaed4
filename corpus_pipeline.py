"""The corpus pipeline: quality rules, near copies, personal data, the mix of sources, packing.

Each stage takes (spark, docs, sf_dir), where docs is the stored result of the one before, and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import jaccard, mixing, packing, pii, quality
from marketlens.llm.common import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail the base rules and go; repeated rows have equal verdicts;
    long texts are read whole; an empty table stays empty; further columns, whatever their names, pass unchanged."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the least doc_id, null last, the first of tied rows. Documents without
    words link with nothing and stay; an empty table stays empty; further columns pass unchanged."""
    return jaccard.without_near_copies(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers, dates and addresses in the text become pseudonyms under the session's key. Null texts stay null; equal
    values in different documents stay equal; no row goes; further columns pass unchanged."""
    return pii.masked(docs, pii.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none more than three times. A null source is a source of its own, last in the
    order; null and empty texts have size 0 and follow their source's passes; an empty table stays empty; further columns pass."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens. A null or empty text is its end token alone; repeated rows are packed each; long texts
    are tokenized whole and cut; an empty table gives no pieces. Only the columns of pieces are returned."""
    return packing.packed(docs, words_held=packing.FEW_WORDS)  # the stages before have filled the executors' memory


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("pii", mask_pii),
    ("mix", mix_sources),
    ("pack", pack),
]

#: A trained language model, keyed digests and a tokenizer decide, so no SQL: tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
