"""Landed documents as files: one fetched document per file.

``landed_documents`` reads a folder (or glob) of RSS/Atom/JSON documents
as whole-file rows ``(feed_url, payload)`` -- the file path stands for the
URL the document was fetched from -- ready for ``feed_items`` or
``json_items``. Files are read whole (``wholetext``): a document is one
value, as a fetched body is; each file is one task's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed_documents(spark: SparkSession, path: str, source_col: str = "feed_url",
                     payload_col: str = "payload") -> DataFrame:
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias(source_col), F.col("value").alias(payload_col)))
