"""op12: two tokenizations of every document aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_documents
from .common import table

TOKENIZER, MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None,
                                   model_file: str | None = None) -> DataFrame:
    if tokenizer_file is None or model_file is None:
        import public_tokenizers
        tokenizer_file = tokenizer_file or public_tokenizers.path(TOKENIZER)
        model_file = model_file or public_tokenizers.path(MODEL)
    out = align_documents(table(spark, sf_dir, "documents"), "doc_id", tokenizer_file, model_file, keep_groups=False)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment}
ORACLE: dict[str, str] = {}
