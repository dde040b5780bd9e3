"""Saved outputs (O6) and published outputs.

The reference keeps one row per (flow, format), replaced on every run.
Here every save appends a version row to a Parquet table (append-only:
no read-modify-write, safe when tasks are retried) and the latest version
is a view: ``row_number() over (partition by flow_id, format order by
created_at desc) = 1``. Spark plans that with a partial
``WindowGroupLimit`` before the shuffle, so a flow with very many versions
costs one row per input partition.

``seq`` numbers the saves (nanoseconds, strictly increasing within a
process), so that of several saves within a second the last one wins. A
document of any size is stored as ordered chunks (``chunk``) of one save.
``latest_chunks`` returns the newest save as such rows and ``publish_document``
writes them in order as part files, both at any size; ``latest_documents`` and
``read_published`` put them together in one value of at most ``max_bytes`` and
fail beyond.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..session import path_exists
from .documents import write_chunks

VERSION_SCHEMA = ("flow_id string, format string, content string, content_type string, "
                  "created_at bigint, seq bigint, chunk bigint")

#: UTF-8 bytes of a document that may be put together in one value.
DOCUMENT_BYTES = 256 << 20

_last_seq = 0


def _next_seq() -> int:
    global _last_seq
    _last_seq = max(_last_seq + 1, time.time_ns())
    return _last_seq


def save_output(spark: SparkSession, table_path: str, flow_id: str, fmt: str,
                documents: DataFrame, content_type: str, created_at: int | None = None) -> int:
    """Append ``documents`` (column ``document``, one row or, with a column
    ``chunk``, the ordered pieces of one document) as a new version. Zero
    rows -> nothing appended, the previous output stays."""
    ts = int(created_at if created_at is not None else time.time())
    owner = F.lit(flow_id) if isinstance(flow_id, str) else flow_id  # a column: many flows saved at once
    chunk = F.col("chunk").cast("bigint") if "chunk" in documents.columns else F.lit(0).cast("bigint")
    rows = documents.select(owner.alias("flow_id"), F.lit(fmt).alias("format"),
                            F.col("document").alias("content"), F.lit(content_type).alias("content_type"),
                            F.lit(ts).cast("bigint").alias("created_at"),
                            F.lit(_next_seq()).cast("bigint").alias("seq"), chunk.alias("chunk"))
    seen = Observation()  # the rows are made once: counted while they are written
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(table_path)
    return int(seen.get["n"])


def latest_versions(versions: DataFrame, keys=("flow_id", "format"), ts="created_at",
                    tie: str | None = None) -> DataFrame:
    """O6 view: the newest row per key."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    w = Window.partitionBy(*keys).orderBy(*order)
    return versions.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def latest_chunks(versions: DataFrame, keys=("flow_id", "format")) -> DataFrame:
    """The rows of the newest save per key, at any size: the document is
    their ``content`` in the order of ``chunk``. The newest save is found by a
    partial ``max``."""
    return _newest(versions, keys, F.lit(0)).drop("__newest")


def _newest(versions: DataFrame, keys, size: Column) -> DataFrame:
    """Rows of the newest save per key, with its summed ``size`` in ``__newest``."""
    saves = versions.groupBy(*keys, "created_at", "seq").agg(F.coalesce(F.sum(size), F.lit(0)).alias("size"))
    newest = saves.groupBy(*keys).agg(F.max(F.struct("created_at", "seq", "size")).alias("__newest"))
    return versions.join(newest, list(keys)).where(
        F.struct("created_at", "seq") == F.struct("__newest.created_at", "__newest.seq"))


def latest_documents(versions: DataFrame, keys=("flow_id", "format"), max_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """The newest saved document per key (``content``, ``content_type``),
    its chunks in order. A document above ``max_bytes`` fails the job before its
    chunks meet in one group."""
    msg = f"a saved document has more than {max_bytes} bytes for one value; raise max_bytes or use latest_chunks"
    content = F.when(F.col("__newest.size") > max_bytes, F.raise_error(F.lit(msg)).cast("string")) \
        .otherwise(F.col("content")).alias("content")
    chunks = _newest(versions, keys, F.octet_length("content")).select(*keys, "content_type", "created_at", "chunk", content)
    return chunks.groupBy(*keys, "content_type", "created_at").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk", "content"))), lambda c: c["content"]), "").alias("content"))


def published_outputs(flows: DataFrame, latest: DataFrame, fmt: str = "json",
                      flow_key: str = "flow_id") -> DataFrame:
    """The latest output in ``fmt`` of every public flow."""
    return flows.where(F.col("is_public")).select(flow_key) \
        .join(latest.where(F.col("format") == fmt), flow_key)


def flows_to_run(flows: DataFrame, latest: DataFrame, fmt: str = "json",
                 flow_key: str = "flow_id") -> DataFrame:
    """O7 "run if absent": public flows without an output in ``fmt``."""
    return flows.where(F.col("is_public")).select(flow_key) \
        .join(latest.where(F.col("format") == fmt), flow_key, "left_anti")


def _serve(spark: SparkSession, versions_path: str, flows: DataFrame, flow_id: str, fmt: str, run_if_absent, found):
    """``found(versions of the flow in fmt)`` if the flow is public; when that
    is None and ``run_if_absent`` is given, it is called once and the lookup
    repeated. The filters on flow and format reach the Parquet scan."""
    def lookup():
        if not path_exists(spark, versions_path):
            return None  # no version written yet
        versions = spark.read.schema(VERSION_SCHEMA).parquet(versions_path)
        return found(versions.where((F.col("flow_id") == flow_id) & (F.col("format") == fmt)))

    if flows.where((F.col("flow_id") == flow_id) & F.col("is_public")).isEmpty():
        return None  # unknown or private flow: nothing is served, nothing runs
    got = lookup()
    if got is None and run_if_absent is not None:
        run_if_absent()
        got = lookup()
    return got


def read_published(spark: SparkSession, versions_path: str, flows: DataFrame, flow_id: str,
                   fmt: str = "json", run_if_absent=None, max_bytes: int = DOCUMENT_BYTES):
    """O7 for one request: the latest content of a public flow in ``fmt``
    (``(content, content_type)`` or None; a document above ``max_bytes`` fails,
    see ``publish_document``). When there is none yet and ``run_if_absent`` is
    given, it is called once (e.g. ``run_flow`` with a versions table)."""
    def found(mine):
        row = latest_documents(mine, max_bytes=max_bytes).select("content", "content_type").first()
        return None if row is None else (row["content"], row["content_type"])
    return _serve(spark, versions_path, flows, flow_id, fmt, run_if_absent, found)


def publish_document(spark: SparkSession, versions_path: str, flows: DataFrame, flow_id: str, path: str,
                     fmt: str = "json", run_if_absent=None):
    """O7 at any size: the latest document of a public flow in ``fmt`` as text
    part files in order under ``path`` (its content type, or None if there is
    none), by a distributed sort."""
    def found(mine):
        chunks = latest_chunks(mine)
        row = chunks.select("content_type").first()
        if row is None:
            return None
        write_chunks(_broken_at_lines(chunks), path)
        return row["content_type"]
    return _serve(spark, versions_path, flows, flow_id, fmt, run_if_absent, found)


def _broken_at_lines(chunks: DataFrame) -> DataFrame:
    """``(chunk, document)``, every later chunk beginning with a line break as
    ``write_chunks`` wants it: what stands before a chunk's first line break
    goes to the chunk before it. Numbers with gaps, or two chunks on end
    without a line break, fail."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("low"), F.max("chunk").alias("high")).first()
    if (n["low"], n["high"]) != (0, n["n"] - 1):
        raise ValueError("the chunks of a saved document are not numbered from 0 without gaps")
    later, text, at = F.col("chunk") > 0, F.col("content"), F.instr("content", "\n")
    rows = chunks.select("chunk", F.coalesce("content", F.lit("")).alias("content"))
    cut = rows.select(
        "chunk", (later & (at == 0)).alias("torn"),
        F.when(later, F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)).alias("head"),
        F.when(later, F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(F.lit(""))).otherwise(text).alias("rest"))
    heads = cut.select((F.col("chunk") - 1).alias("chunk"), F.col("head").alias("next"))
    whole = F.concat("rest", F.coalesce("next", F.lit("")))
    fail = F.raise_error(F.lit("chunks without a line break; read them with latest_chunks")).cast("string")
    return cut.drop("head").join(heads, "chunk", "left").where(~F.col("torn") | (whole != "")) \
        .select("chunk", F.when(F.col("torn"), fail).otherwise(whole).alias("document"))
