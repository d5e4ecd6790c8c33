"""Session defaults, and the one place that decides where intermediate tables go."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "forumgauge", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here fixes a parallelism for the cluster: shuffle partitions and the
    checkpoint folder come from the deployment (``conf`` or spark-defaults).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is whatever the session names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own, since a folder on one
    machine is lost together with that machine; it is deleted when Python ends. The
    owner of a named folder clears it after the session.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="forumgauge-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from that table.

    For a table that several plans read: it is computed once, later reads prune columns,
    and its size is known to the join planner.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: like ``written``, but keeps its partitions and order."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the files of tables that nothing refers to any more, for loops that make many of them.

    Spark notices such shuffle files, and checkpoints if the session has ``spark.cleaner.referenceTracking.cleanCheckpoints``,
    when the driver collects garbage, which one with much memory may not do for hours.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
