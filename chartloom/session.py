"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Spark removes the shuffle files of an execution when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_inside: ContextVar[list[DataFrame] | None] = ContextVar("tables written inside alone()", default=None)


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "chartloom") -> SparkSession:
    """A local session as tests and bench use it: UTC, AQE on, few shuffle partitions.

    Workers find this package by PYTHONPATH; on a cluster it is shipped with --py-files or installed.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named, a session in one local process gets a folder of its own; on a cluster, whose executors would
    not see such a folder, that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor sees")
        named = tempfile.mkdtemp(prefix="chartloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: its files outlive the executors that wrote them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table written once to the shared folder, so that they are computed once and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)  # a stronger codec would hide from Spark how large a table is when it is broadcast
    finally:
        spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if (inside := _inside.get()) is not None:
        inside.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` returned; nothing that is still to be computed may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """written(make()), without the tables that were written on the way."""
    outer = _inside.set(inside := [])
    try:
        df = make()
    finally:
        _inside.reset(outer)
    out = written(df)
    discard(*inside)
    return out
