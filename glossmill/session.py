"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ONCE = "__once__"


def build_session(cores: int | str = "*", name: str = "glossmill", **conf: str) -> SparkSession:
    """A local session with the settings the operators are tuned for; a cluster passes its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(os.cpu_count() if cores == "*" else cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        # Arrow batches of long prompts are bounded by bytes, not only by rows.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
        # Do not record a Python stack trace for every column expression.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage, read from the session.

    Only a local session without the setting gets a temporary folder; on a cluster the folder must be
    reachable from every executor, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="glossmill-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_root(spark: SparkSession) -> str:
    """The application's own folder under the shared one."""
    return f"{checkpoint_root(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path in the application's folder.  It stays until ``released``."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to a fresh table in the shared folder and read them back.

    For rows used more than once: they are computed once, and later scans read only the columns and
    row groups they need.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, path: str | None = None) -> None:
    """Delete a path that ``scratch_path`` gave out, or all of them, once nothing reads them any more."""
    root = scratch_root(spark)
    if path is not None and not path.startswith(f"{root}/"):
        raise ValueError(f"{path} is not a scratch path of this application")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path or root)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is evaluated exactly once per row.

    A filter on a plain computed column is pushed below it and computes it again, once per mention.
    Filters cannot pass a generator whose output they use.  The value itself is a plain column below the generator,
    where Spark compiles it; inside a generator it would be interpreted.
    """
    ready = df.select("*", value.alias(_ONCE))
    return ready.select("*", F.explode(F.array(_ONCE)).alias(name)).drop(_ONCE)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on ``keys`` over the session's number of shuffle partitions, whatever the scan had."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
