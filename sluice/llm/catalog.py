"""The training-data operators as queries over the given tables, with DuckDB
SQL where SQL can express them. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (q_alignment, q_chat, q_decontaminate, q_dedup, q_licenses, q_lm, q_mixing, q_negatives, q_pieces, q_quality, q_sharding,
               q_tokens, q_toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for _module in (q_sharding, q_quality, q_tokens, q_toxicity, q_lm, q_dedup, q_decontaminate, q_mixing, q_licenses, q_chat,
                q_pieces, q_alignment, q_negatives):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
