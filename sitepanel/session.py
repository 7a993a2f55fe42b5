"""Session defaults and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings this library is tested with.

    On a cluster leave ``master`` to spark-submit and size
    ``spark.sql.shuffle.partitions`` there; adaptive execution coalesces down
    from whatever upper figure is given.
    """
    builder = (
        SparkSession.builder.appName("sitepanel")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # moment tables have up to a few hundred columns; keep them in generated code
        .config("spark.sql.codegen.maxFields", "400")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset, only a session whose driver is its one executor gets a
    temporary folder, kept here and not in the session; any other gets None,
    so nothing is written to one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        return None
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="sitepanel-")
    return _OWN_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise a frame that several jobs read, so that it is computed once.

    The frame is written to the shared folder and read back: its lineage ends
    there, later jobs prune columns, and lost executors cost nothing.  (An RDD
    checkpoint would run the last stage a second time.)  Without a shared
    folder the frame is persisted with its lineage, which Spark replays.
    """
    spark = df.sparkSession
    if shared_folder(spark) is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch_path(spark, "frame")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
