"""op13: sentencepiece ids of all documents, and their text again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sentence_pieces import SentencePieces

MODEL = "piece_bpe_32k.model"


def op13_agenda_pieces(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    if model_file is None:
        import public_tokenizers
        model_file = public_tokenizers.path(MODEL)
    pieces = SentencePieces(spark, model_file)
    docs = table(spark, sf_dir, "documents")
    coded = docs.select("doc_id", pieces.round_trip(docs["text"]).alias("e")).select("doc_id", "e.*")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "agrees")


QUERIES = {"op13_agenda_pieces": op13_agenda_pieces}
ORACLE: dict[str, str] = {}
