"""Session settings, and the folder that holds cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "backtrail", cores: int | str = 8) -> SparkSession:
    """A session for tests and single-machine runs."""
    cores_text = str(cores)
    shuffle = cores_text if cores_text.isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cores_text}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and captured tables.

    The cluster names it in `spark.checkpoint.dir`. A machine-local folder is made only
    in local mode; on a cluster other executors could not read it, so that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if sc.getCheckpointDir() is not None:
            return sc.getCheckpointDir()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="backtrail-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def durable(df: DataFrame) -> DataFrame:
    """The same rows with the plan behind them cut, safe against executor loss."""
    scratch_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; a `scratch` block that is open drops it at its end."""
    path = os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")
    for made in _open_blocks:
        made.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and read them back.

    Preferred to `durable` where later reads filter: row groups can then be skipped.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open_blocks: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that are stored inside the block when it ends.

    What the block is for must be written by then, to a path of the caller's own: frames over
    its tables cannot be read any more.
    """
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks[:] = [held for held in _open_blocks if held is not made]
        drop(spark, *made)


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables from the shared folder, whatever file system it is on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
