"""op7: benchmark items found in the documents, one row per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import find_matches


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_cgk_decontamination": op7_cgk_decontamination}
ORACLE: dict[str, str] = {}
