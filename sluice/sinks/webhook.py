"""Webhook delivery.

Payload rows ``(batch, count, payload)`` from ``webhook_batches`` are posted by
the tasks that hold them; nothing passes through the driver. Target by URL:

* ``http(s)://`` -- POST, ``Content-Type: application/json`` plus the configured
  headers, 30 s timeout; a status >= 400 or no answer counts as not delivered.
* any path or URL of a Spark file system (``file:``, ``hdfs:``, ``s3a:``) -- one
  line per batch, many batches in a file, written by Spark (a retried task leaves
  nothing twice).

With a ``ledger`` (an append-only Parquet table: target, batch, digest of the payload, status)
a delivery that is repeated sends only what is missing: rows whose digest the
ledger holds as delivered are left out by an anti join before anything is posted.
A task goes on after a batch that fails and reports every batch, so what was
sent is on record before the job fails for the rest. Only a task that is lost while it
posts may send its own batches again; receivers can tell by the header
``Idempotency-Key``, the digest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, path_exists, stage

TIMEOUT_SECONDS = 30
LEDGER = "target string, batch bigint, digest string, status int"


def post(url: str, body: bytes, headers: dict[str, str]) -> int:
    """HTTP status of one request (599: no answer)."""
    import urllib.error
    import urllib.request
    req = urllib.request.Request(url, data=body, method="POST", headers={"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(req, timeout=TIMEOUT_SECONDS) as resp:
            return resp.status
    except urllib.error.HTTPError as e:
        return e.code
    except OSError:
        return 599


def _ship() -> None:
    """Tasks get this module by value: executors need not have the package."""
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _posted(payloads: DataFrame, url: str, headers: dict[str, str], transport: Callable[[str, bytes, dict], int]) -> DataFrame:
    """Posts every row; one ledger row each."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            digests = rows.column(1).to_pylist()
            status = [transport(url, body.encode(), {**headers, "Idempotency-Key": digest})
                      for digest, body in zip(digests, rows.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([url] * len(rows), pa.string()), rows.column(0), rows.column(1),
                                              pa.array(status, pa.int32())], names=["target", "batch", "digest", "status"])
    return payloads.select("batch", "digest", "payload").mapInArrow(send, LEDGER)


def delivered(spark: SparkSession, ledger: str, url: str) -> DataFrame:
    """Digests and batches that the ledger holds as delivered to ``url``."""
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], "batch bigint, digest string")
    return spark.read.schema(LEDGER).parquet(ledger).where((F.col("target") == url) & (F.col("status") < 400)) \
        .select("batch", "digest").distinct()


def deliver(payloads: DataFrame, url: str, headers: dict[str, str] | None = None, ledger: str | None = None,
            transport: Callable[[str, bytes, dict], int] = post) -> None:
    """Send every payload row, with a ``ledger`` those it does not hold yet;
    raises if a batch could not be delivered, after all others were."""
    spark = payloads.sparkSession
    rows = payloads.select("batch", F.col("payload"), F.sha2("payload", 256).alias("digest"))
    if ledger is not None:
        rows = rows.join(delivered(spark, ledger, url), ["batch", "digest"], "left_anti")
    if not url.startswith(("http://", "https://")) and transport is post:
        sent, path = stage(rows, "webhook-files") if ledger is not None else (rows, None)
        sent.select(F.col("payload").alias("value")).write.mode("overwrite" if ledger is None else "append").text(url)
        if ledger is not None:
            sent.select(F.lit(url).alias("target"), "batch", "digest", F.lit(200).alias("status")).write.mode("append").parquet(ledger)
            discard(spark, path)
        return
    _ship()
    sent, path = stage(_posted(rows, url, headers or {}, transport), "webhook-sent")
    if ledger is not None:
        sent.write.mode("append").parquet(ledger)
    failed = sent.where(F.col("status") >= 400).agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("batch"), F.max("status").alias("status")).first()
    discard(spark, path)
    if failed["n"]:
        raise RuntimeError(f"webhook: {failed['n']} batches were not delivered (from batch {failed['batch']} on; status up to {failed['status']})")
