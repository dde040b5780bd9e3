"""op4: near-duplicate class of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .near_dedup import class_table


def op4_dart_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_dart_minhash_classes": op4_dart_minhash_classes}
ORACLE: dict[str, str] = {}
