"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Fixed value: the white space of the word rule ``[^\x20\x09-\x0D]+``.
WORD_SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
#: The same white space spelled out, for ``translate``.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(tag: str) -> str:
    """A column name that no input column has (inputs may bring any names)."""
    return f"__{tag}_{uuid.uuid4().hex[:10]}"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, tag: str, arrow_rows: int | None = None) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: lineage ends
    there, so a lost executor costs a re-read. Returns the folder too, for
    ``discard``. ``arrow_rows`` bounds the rows of a batch sent to Python
    while this table is written (wide rows: less memory)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{tag}-{uuid.uuid4().hex}")
    schema = df.schema
    before = spark.conf.get(ARROW_ROWS)
    if arrow_rows is not None:
        spark.conf.set(ARROW_ROWS, str(arrow_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Give freed memory of this Python worker back to the system (workers
    live on between tasks and stages)."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: its allocator decides
        pass


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as the empty text."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(m))
