"""A training corpus from raw documents: quality rules, near-duplicates,
benchmark decontamination, mixing to target weights, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. Each works on all that its predecessor
kept. Nulls, empty texts, repeated rows and empty tables are handled as the
operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.common import materialize, table
from sluice.llm.decontaminate import decontaminate
from sluice.llm.mixing import sample
from sluice.llm.near_dedup import deduplicate
from sluice.llm.q_mixing import BUDGET, TARGETS, dimensions
from sluice.llm.q_quality import POLICY
from sluice.llm.q_sharding import TOPOLOGY
from sluice.llm.quality import keep_good
from sluice.llm.sharding import assign_shards


ITEM_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go."""
    return keep_good(docs, table(spark, sf_dir, "labels"), policy=POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of ``ITEM_WORDS`` words or more go
    (a shorter one, say a one-word answer, would take every text with the word)."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), min_words=ITEM_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that their tokens follow the target weights."""
    return sample(docs, TARGETS, dimensions(docs), BUDGET)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its region, rack and shard."""
    return assign_shards(docs, "doc_id", TOPOLOGY)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("sharding", sharding),
]

#: Near-duplicate classes and edit distances are not expressible in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
