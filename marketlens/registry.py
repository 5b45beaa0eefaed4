"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.operators import applied, creatives, ingest, membership, more, recommend, relations, rollups, scoring, similar, trend, vectors
from marketlens.operators.scoring import FLAGSHIP

OPERATORS = [*scoring.OPERATORS, *rollups.OPERATORS, *relations.OPERATORS, *applied.OPERATORS, *more.OPERATORS, *ingest.OPERATORS, *membership.OPERATORS, *creatives.OPERATORS, *vectors.OPERATORS, *trend.OPERATORS, *similar.OPERATORS, *recommend.OPERATORS]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {o.name: o.spark for o in OPERATORS}
ORACLES: dict[str, str] = {o.name: sql for o in OPERATORS if (sql := o.other())}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FLAGSHIP.spark(spark, sf_dir)
