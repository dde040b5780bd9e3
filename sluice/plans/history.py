"""Run history (R1-R6) as queries over append-only run tables.

``flow_executions``: one row per run (id, flow_id, status, trigger_type,
started_at, completed_at, duration_ms, items_processed, error_message).
``execution_logs``: (id, execution_id, node_id, level, message,
timestamp, seq). ``flows``: (id, user_id, is_public).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_SCHEMA = ("id string, flow_id string, status string, trigger_type string, started_at bigint, "
              "completed_at bigint, duration_ms bigint, items_processed bigint, error_message string")
LOG_SCHEMA = ("id string, execution_id string, node_id string, level string, message string, "
              "timestamp bigint, seq bigint")
DEFAULT_RUNS = 10
MAX_RUNS = 100


def runs_page_size(limit) -> int:
    """The run list's ``limit``: default 10, accepted 1..100."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        return DEFAULT_RUNS
    return n if 0 < n <= MAX_RUNS else DEFAULT_RUNS


def recent_runs(runs: DataFrame, limit=DEFAULT_RUNS, flow_col="flow_id", started_col="started_at",
                tie_col="id") -> DataFrame:
    """R1 for every flow at once: newest first, ``limit`` per flow, with the
    position as ``n`` (a per-key ``WindowGroupLimit``)."""
    n = runs_page_size(limit)
    w = Window.partitionBy(flow_col).orderBy(F.col(started_col).desc(), F.col(tie_col).desc())
    return runs.withColumn("n", F.row_number().over(w).cast("bigint")).where(F.col("n") <= n)


def run_log(logs: DataFrame, run_col="execution_id", ts_col="timestamp", seq_col="seq") -> DataFrame:
    """R2 for every run: log lines by time, then sequence, numbered.

    Skew-safe: the numbering comes from ``rank_within`` (range-partitioned
    global rank), not from a per-run window, so one huge run is spread over
    many tasks."""
    from ..feed import Feed
    from .rank import rank_within
    feed = Feed.from_table(logs, [ts_col, seq_col])
    return rank_within(feed, [run_col], "line").items()


def owner_logs(logs: DataFrame, runs: DataFrame, flows: DataFrame, owner_pred,
               run_key=("execution_id", "id"), flow_key=("flow_id", "id")) -> DataFrame:
    """Log lines of runs whose flow belongs to an owner.

    Two joins, the second a left-semi join on the filtered flows; Spark
    picks broadcast or sort-merge from the sizes (AQE re-plans at run time),
    and the owner filter is pushed into the flows scan."""
    owned = flows.where(owner_pred).select(F.col(flow_key[1]).alias("__flow"))
    r = runs.select(F.col(run_key[1]).alias("__run"), F.col(flow_key[0]).alias("__flow"))
    return logs.join(r, logs[run_key[0]] == r["__run"]) \
        .join(owned, "__flow", "left_semi").drop("__run", "__flow")
