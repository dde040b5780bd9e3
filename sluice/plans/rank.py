"""Global position of every item in feed order, without a single-partition
window.

1. range-partition by the ordering and sort within partitions (the
   ordering ends with unique position columns, so a hot key is split
   across partitions like any other range);
2. cut lineage (reliable ``checkpoint`` to the shared checkpoint folder)
   so the partition ids stay fixed if an executor is lost;
3. ``monotonically_increasing_id`` then encodes (partition id, index in
   partition) -- exact here because we made the partitioning;
4. per-partition counts (one row per partition: bounded by the partition
   count, so broadcasting them is safe) give each partition's offset.

Both functions sort and checkpoint when they are called, so they are for batch
feeds.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..feed import Feed, col, fresh
from ..session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def _sorted_once(feed: Feed, partitions: int | None, mid: str):
    """The rows range-partitioned and sorted by the ordering, with (partition,
    index) in ``mid``; lineage ends here."""
    spark = feed.df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a feed without an ordering keeps the order in which its partitions hold it
    sorted_df = feed.df if not feed.ordering else feed.df.repartitionByRange(n, *feed.order_columns()) \
        .sortWithinPartitions(*feed.order_columns())
    ensure_checkpoint_dir(spark)
    return sorted_df.withColumn(mid, F.monotonically_increasing_id()).checkpoint(eager=True)


def global_rank(feed: Feed, name: str = "rank", partitions: int | None = None) -> Feed:
    mid, pid = fresh("mid"), fresh("pid")
    with_id = _sorted_once(feed, partitions, mid)
    counts = with_id.select(F.shiftrightunsigned(col(mid), 33).alias(pid)).groupBy(pid).agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: the running offset is computed on <= n rows
    offsets = counts.select(col(pid), (F.sum("__n").over(Window.orderBy(pid)) - col("__n")).alias("__off"))
    ranked = with_id.withColumn(pid, F.shiftrightunsigned(col(mid), 33)) \
        .join(F.broadcast(offsets), pid) \
        .withColumn(name, col("__off") + col(mid).bitwiseAND(F.lit(_LOW_BITS)) + 1) \
        .drop(pid, "__off", mid)
    return feed.with_df(ranked)


def rank_within(feed: Feed, keys: list[str], name: str = "rank") -> Feed:
    """1-based position of each item within its key, in feed order, without
    a per-key window (a key holding a third of the rows would otherwise be
    sorted in one task) and without a join on the key.

    After the range sort by (key, ordering) a key's rows lie in one partition
    or in several on end. They are numbered inside (partition, key); a key that
    continues in the next partition carries on from the rows it has had. The
    carries come from the first and last key of each partition: at most one
    row per partition, which is what travels to every task."""
    from ..feed import OrderKey
    mid, pid, inside, carry = (fresh(x) for x in ("mid", "pid", "in", "carry"))
    keyed = Feed(feed.df, [OrderKey(k) for k in keys] + list(feed.ordering))
    rows = _sorted_once(keyed, None, mid).withColumn(pid, F.shiftrightunsigned(col(mid), 33))
    key = F.struct(*[col(k) for k in keys])
    edges = rows.groupBy(pid).agg(F.min_by(key, col(mid)).alias("__first"), F.max_by(key, col(mid)).alias("__last"))
    # rows of each partition's last key in it: what the key brings to the next partition
    brought = rows.join(F.broadcast(edges.select(pid, "__last")), pid).where(key.eqNullSafe(col("__last"))) \
        .groupBy(pid).agg(F.count(F.lit(1)).alias("__n"), F.first("__last").alias("__key"))
    asks = edges.select(col(pid), F.lit(0).cast("bigint").alias("__n"), col("__first").alias("__key"), F.lit(0).alias("__kind"))
    moves = asks.unionByName(brought.select(col(pid), "__n", "__key", F.lit(1).alias("__kind")))
    w = Window.partitionBy("__key").orderBy(pid, "__kind").rowsBetween(Window.unboundedPreceding, -1)
    carries = moves.withColumn(carry, F.sum("__n").over(w)).where((col("__kind") == 0) & (col(carry) > 0)) \
        .select(col(pid), col("__key"), col(carry))
    numbered = rows.withColumn(inside, F.row_number().over(Window.partitionBy(pid, *[col(k) for k in keys]).orderBy(mid)))
    joined = numbered.join(F.broadcast(carries.withColumnRenamed(pid, "__at")),
                           (col(pid) == col("__at")) & key.eqNullSafe(col("__key")), "left")
    out = joined.withColumn(name, col(inside) + F.coalesce(col(carry), F.lit(0))) \
        .drop(mid, pid, inside, carry, "__at", "__key")
    return feed.with_df(out)
