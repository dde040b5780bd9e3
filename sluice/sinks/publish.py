"""Outputs that change by a pointer.

An output folder holds immutable versions and a table of pointer rows:

    <path>/_versions/<name>/          one completely written output
    <path>/_pointers/seq=<n>/         one row: the version that is current from n on

A new output is written as a version of its own; the pointer row is written last,
by an append that Spark commits in one step. Nothing that readers may see is
deleted or renamed before, so a job that ends at any step leaves the earlier
output as it was. The row with the greatest ``seq`` counts. Afterwards the
versions and pointer rows beyond the ``KEEP`` newest are removed, so a reader
that has just looked up its version can finish.

One job at a time writes an output (``seq`` is the clock, and larger than
any pointer that is there).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import discard, list_names, path_exists

KEEP = 2
_SCHEMA = "version string, seq bigint"


def _pointers(spark: SparkSession, path: str):
    return spark.read.schema(_SCHEMA).parquet(f"{path}/_pointers")


def current_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """``(seq, version)`` of the pointer row that counts."""
    path = path.rstrip("/")
    if not path_exists(spark, f"{path}/_pointers"):
        return None
    top = _pointers(spark, path).agg(F.max(F.struct("seq", "version")).alias("top")).first()["top"]
    return None if top is None else (top["seq"], top["version"])


def current_output(spark: SparkSession, path: str) -> str:
    """The folder of the output that counts now; fails if there is none."""
    path = path.rstrip("/")
    top = current_version(spark, path)
    if top is None:
        raise FileNotFoundError(f"no output has been published at {path}")
    return f"{path}/_versions/{top[1]}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``write`` gets the folder of a new version; once it has returned the
    version becomes the current one. Returns its folder."""
    path = path.rstrip("/")
    version = uuid.uuid4().hex
    write(f"{path}/_versions/{version}")
    point_to(spark, path, version)
    prune(spark, path)
    return f"{path}/_versions/{version}"


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Append the pointer row of a written version."""
    before = current_version(spark, path)
    seq = max(time.time_ns(), before[0] + 1 if before else 0)
    spark.createDataFrame([(version, seq)], _SCHEMA).coalesce(1).write.mode("append").partitionBy("seq").parquet(f"{path}/_pointers")


def prune(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Remove versions that no pointer row among the ``keep`` newest names,
    and the older pointer rows (first: a row never outlives its version)."""
    rows = sorted(((r["seq"], r["version"]) for r in _pointers(spark, path).collect()), reverse=True)  # at most keep + 1 rows
    kept = {version for _, version in rows[:keep]}
    discard(spark, *[f"{path}/_pointers/seq={seq}" for seq, _ in rows[keep:]])
    discard(spark, *[f"{path}/_versions/{name}" for name in list_names(spark, f"{path}/_versions") if name not in kept])
