"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Sizing (executors, memory) is left to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Several plans join and then group by one key in a single shuffle. When the
    # key turns out to be skewed, its partition is split all the same and the
    # grouping gets a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that are dealt by some of a join's keys stay where they are. Otherwise what
    # was joined sheet by sheet is shuffled whole for the next join on sheet and line.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Compressed files understate rows in memory; without this, score tables of
    # a few megabytes on disk pass for broadcastable.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # Duplicate keys in a scoresheet text: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}
# Lets Spark remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# For sessions that name no sizes of their own. A task sorts and groups several times what its
# shuffled bytes say. Small partitions keep that in memory, and there are enough to begin with
# for large tables to have small ones.
SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a session made elsewhere, and SIZES where it names none."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return importing(spark)


def importing(spark: SparkSession) -> SparkSession:
    """Let the session's Python workers import this package from where the driver did."""
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return spark


def local_session(
    cores: str | int = "*", partitions: int = 8, memory: str = "16g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in (SETTINGS | SIZES).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders written by `scratch`, for `clearing` to remove.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the driver and all executors can reach, as the session names it."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new folder for intermediate tables and stream checkpoints, in the shared folder of the session.

    ``clearing`` leaves it alone with ``keep``.
    """
    base = shared_folder(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not keep:
        _written.append(path)
    return path


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write made inside go from the disks of the executors when it has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Remove at the end the scratch folders made inside. Results must be written or read by then.

    What later work is to read must be made before.
    """
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _written[before:]


def stage(rows: DataFrame, label: str, options: dict[str, object] | None = None) -> DataFrame:
    """Write ``rows`` once, with the ``options`` of the writer, and go on from the written table.

    For results that several later steps read, and for ids that must be handed
    out once even when executors are lost.
    """
    path = scratch(rows.sparkSession, label)
    with dropping_shuffles(rows.sparkSession):
        rows.write.options(**(options or {})).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
