"""op10: token counts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes
from .token_counts import token_counter

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512


def op10_rank_synchronous_tokens(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers
        tokenizer_file = public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf_dir, "documents")
    counted = token_counter(spark, tokenizer_file)
    out = docs.select("doc_id", F.octet_length(text_bytes(docs["text"])).cast("long").alias("n_bytes"),
                      counted(docs["text"]).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op10_rank_synchronous_tokens": op10_rank_synchronous_tokens}
ORACLE: dict[str, str] = {}
