"""Session helpers: local session for tests, shared work folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, name: str = "tabwright") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN_FOLDERS: dict[str, str] = {}  # by application id, where no shared folder is set


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; a cluster
    without the setting is an error, since executors share no local disk. The
    setting can't change while Spark runs, so that folder is remembered here.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    run = spark.sparkContext.applicationId
    if run not in _OWN_FOLDERS:
        _OWN_FOLDERS[run] = os.environ.get("TABWRIGHT_WORK_DIR") or tempfile.mkdtemp(prefix="tabwright-")
    return _OWN_FOLDERS[run]


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh path in this run's own folder below the shared one; the folder goes when the driver ends."""
    root = f"{work_dir(spark).rstrip('/')}/tabwright-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{root}/{stem}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder; rows keep no order."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """All rows of ``df`` if it has at most ``limit`` rows, else None."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
