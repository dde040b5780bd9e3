"""op9: toxicity scores of all documents, learned from three quarters of the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .toxicity import fit_machine, scorer

PER_CLASS = 3000
THRESHOLD = 0.3


def op9_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    labels = labels.filter(crc_mod(labels["doc_id"], 4) != 2)
    scored = scorer(spark, fit_machine(docs, labels, per_class=PER_CLASS))
    return docs.select("doc_id", (crc_mod(docs["doc_id"], 4) == 2).alias("held_out"),
                       scored(docs["text"]).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op9_factorization_machine_toxicity": op9_factorization_machine_toxicity}
ORACLE: dict[str, str] = {}
