"""Streams that remember what earlier runs have seen (X2-X4), by state tables.

Each micro-batch reads the state that the batches before it have written and
adds rows of its own under ``batch_id=<n>``. A retried batch rewrites its own
folder and reads only those of smaller numbers, so it comes out the same; nothing is
updated in place, and a lost executor costs a re-read.

* ``dedupe_forever``: first row per key, also when the key returns long after
  any watermark. Keys lie in ``BUCKETS`` partitions by hash; a batch opens the
  buckets of its own keys and passes their rows through a Bloom filter of
  these keys before the anti join.
* ``top_overall``: the first ``k`` rows of all batches so far; the state is the
  top of the last batch, ``k`` rows, merged with the top of the next one.
* ``changed_payloads_stream``: payloads whose hash differs from the one before
  it of the same feed, inside a batch and across batches.

Batches run with ``foreachBatch`` and ``availableNow``, progress lives in the
checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..feed import Feed, OrderKey, col, fresh
from ..operators.limit import limit_items
from ..plans.rank import rank_within
from ..session import discard, path_exists, stage
from .incremental import _run, payload_hash

BUCKETS = 64
#: 64-bit words of the Bloom filter, which bounds what is broadcast.
FILTER_WORDS = 1 << 18


def _before(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """State rows of earlier batches (``batch_id`` among the columns)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0))
    return spark.read.schema(f"{schema}, batch_id int").parquet(path).where(F.col("batch_id") < batch_id)


def _hash(columns: list[str]) -> Column:
    # xxhash64 skips nulls: their places are hashed too
    return F.xxhash64(*[col(c) for c in columns], *[col(c).isNull() for c in columns])


def possibly_in(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose ``columns`` may be among those of ``wanted``: three bits per
    key in a table of at most ``FILTER_WORDS`` 64-bit words. Many keys let more
    rows pass needlessly, never fewer."""
    h, word, mask, bits = (fresh(x) for x in ("h", "word", "mask", "bits"))

    def placed(df: DataFrame) -> DataFrame:
        one = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(col(h), n), F.lit(64)).cast("int"))
               for n in (20, 30, 40)]
        return df.withColumn(h, _hash(columns)).withColumns(
            {word: F.pmod(col(h), F.lit(FILTER_WORDS)), mask: one[0].bitwiseOR(one[1]).bitwiseOR(one[2])})
    table = placed(wanted).groupBy(word).agg(F.bit_or(mask).alias(bits))
    return placed(rows).join(F.broadcast(table), word).where(col(bits).bitwiseAND(col(mask)) == col(mask)) \
        .drop(h, word, mask, bits)


def _same(left: DataFrame, right: DataFrame, columns: list[str], names: dict[str, str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & left[c].eqNullSafe(right[names[c]])
    return cond


def unseen(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose keys (nulls count as a value) ``seen`` does not hold. ``seen`` has
    the keys and their ``bucket``; only buckets of the batch's keys are read."""
    bucket = F.pmod(_hash(keys), F.lit(BUCKETS)).cast("int")
    mine = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
    names = {k: fresh("seen") for k in keys}
    old = possibly_in(seen.where(F.col("bucket").isin(mine)).select(*[col(k) for k in keys]), batch.select(*[col(k) for k in keys]), keys)
    old = old.distinct().withColumnsRenamed(names)
    return batch.join(old, _same(batch, old, keys, names), "left_anti")


def dedupe_forever(stream: DataFrame, keys: list[str], order_by: list[str], out_path: str, state_path: str,
                   name: str, checkpoint: str | None = None) -> str:
    """X2 without a horizon: the first row per key (``order_by`` inside a batch,
    batches by arrival), appended under ``out_path/batch_id=<n>``. The state is
    one row per key, and a batch reads only what its own keys may hit."""
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields if f.name in keys)

    def handle(batch: DataFrame, batch_id: int) -> None:
        rn = fresh("rn")
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*[col(c).asc_nulls_last() for c in order_by])
        first = batch.withColumn(rn, F.row_number().over(w)).where(col(rn) == 1).drop(rn)
        first, at = stage(first, "stream-first")  # read for the buckets, the filter and the join
        seen = _before(spark, state_path, f"{schema}, bucket int", batch_id)
        unseen(first, seen, keys).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        new = spark.read.schema(first.schema).parquet(f"{out_path}/batch_id={batch_id}")
        new.select(*[col(k) for k in keys], F.pmod(_hash(keys), F.lit(BUCKETS)).cast("int").alias("bucket")) \
            .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/batch_id={batch_id}")
        discard(spark, at)

    _run(stream.writeStream.foreachBatch(handle), name, spark, checkpoint)
    return out_path


def top_overall(stream: DataFrame, order: list[OrderKey], k: int, state_path: str, name: str,
                checkpoint: str | None = None) -> str:
    """X3 across batches: after every batch ``state_path/batch_id=<n>`` holds the
    first ``k`` rows of all data so far. Top-k sets merge: the top of the
    whole is the top of the tops. ``order`` should end in unique columns."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        top = limit_items(Feed(batch, order), k)
        before = latest_top(spark, state_path, batch.schema, batch_id)
        if before is not None:
            top = limit_items(Feed(top.df.unionByName(before), order), k)
        top.df.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")

    _run(stream.writeStream.foreachBatch(handle), name, spark, checkpoint)
    return state_path


def latest_top(spark: SparkSession, state_path: str, schema, before: int | None = None) -> DataFrame | None:
    """The state after the last batch (before number ``before``)."""
    from ..session import list_names
    done = [int(n.split("=")[1]) for n in list_names(spark, state_path) if n.startswith("batch_id=")]
    done = [n for n in done if (before is None or n < before) and path_exists(spark, f"{state_path}/batch_id={n}/_SUCCESS")]
    return spark.read.schema(schema).parquet(f"{state_path}/batch_id={max(done)}") if done else None


def changed_payloads_stream(stream: DataFrame, out_path: str, state_path: str, name: str, key: str = "feed_url",
                            payload_col: str = "payload", fetched_col: str = "fetched_at", checkpoint: str | None = None) -> str:
    """X4 on a stream: payloads (with ``payload_hash``) that differ from the
    payload before them of the same feed, appended under ``out_path/batch_id=<n>``.

    Inside a batch a feed's fetches are ordered by ``fetched_col``, ties by hash; the
    last one of a batch is the one that the next batch with this feed compares with,
    whatever its time. A feed's first payload counts as changed; a null payload
    is a payload of its own. Fetches are numbered without a per-feed
    window, and only hashes travel for that, so a feed with most of the rows is spread."""
    spark = stream.sparkSession
    key_type = stream.schema[key].dataType.simpleString()

    def handle(batch: DataFrame, batch_id: int) -> None:
        row, n, prev = fresh("row"), fresh("n"), fresh("prev")
        digest = F.coalesce(payload_hash(payload_col), F.lit(""))
        rows, rows_at = stage(batch.withColumn("payload_hash", digest).withColumn(row, F.monotonically_increasing_id()), "stream-payloads")
        slim = rows.select(col(key), col(fetched_col), "payload_hash", col(row))
        numbered = rank_within(Feed(slim, [OrderKey(fetched_col), OrderKey("payload_hash"), OrderKey(row)]), [key], n).df
        numbered, numbered_at = stage(numbered.select(col(key), "payload_hash", col(row), col(n)), "stream-numbered")
        state = _before(spark, state_path, f"`{key}` {key_type}, payload_hash string", batch_id)
        known = possibly_in(state, rows.select(col(key)), [key]).groupBy(col(key)) \
            .agg(F.max_by("payload_hash", "batch_id").alias(prev)).select(col(key).alias("__k"), F.lit(0).cast("bigint").alias("__n"), col(prev))
        before = numbered.select(col(key).alias("__k"), col(n).cast("bigint").alias("__n"), F.col("payload_hash").alias(prev)).unionByName(known)
        both = numbered.join(before, numbered[key].eqNullSafe(before["__k"]) & (col(n) - 1 == col("__n")), "left")
        changed = both.where(~F.col("payload_hash").eqNullSafe(col(prev))).select(row)
        rows.join(changed, row, "left_semi").drop(row).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        last = numbered.groupBy(col(key)).agg(F.max_by("payload_hash", col(n)).alias("payload_hash"))
        last.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")
        discard(spark, rows_at, numbered_at)

    _run(stream.writeStream.foreachBatch(handle), name, spark, checkpoint)
    return out_path
