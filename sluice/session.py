"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the semantics depend on (UTC rendering of epoch seconds) and the
# ones that keep plans adaptive at scale. Nothing here caps data.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",  # field names of items are exact
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # reliable checkpoints (global rank) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sluice", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext handle
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``; we only pick our own
    (a fresh scratch folder) when the setting is absent, as in local tests.
    """
    sc = _context(spark)
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = sc.getCheckpointDir() if sc is not None else None
    if conf_dir:
        if sc is not None and not sc_dir:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc_dir:
        spark.conf.set("spark.checkpoint.dir", sc_dir)
        return sc_dir
    master = spark.conf.get("spark.master", "") or (sc.master if sc is not None else "")
    if master and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a shared folder")
    # local mode only (tests, laptops): a fresh scratch folder of our own
    local = tempfile.mkdtemp(prefix="sluice-ckpt-", dir=os.environ.get("SLUICE_SCRATCH", "/tmp"))
    if sc is not None:
        sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def stage(df, tag: str):
    """Write a table once to the shared folder and read it back: what follows
    (sampling for a sort, counting, writing) reads the copy, not the inputs
    again. Returns the table and its folder, for ``discard``."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"staged/{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no later plan reads."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none if it is not there)."""
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
