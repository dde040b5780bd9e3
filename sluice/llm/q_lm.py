"""op6: language-model scores of all documents, learned from four fifths of the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .lm_scoring import score_texts


def op6_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, crc_mod(docs["doc_id"], 5) != 1)
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


QUERIES = {"op6_ppm_scores": op6_ppm_scores}
ORACLE: dict[str, str] = {}
