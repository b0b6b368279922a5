"""What the operators of this folder share: session settings, the scratch folder, components of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import importing, stage

# Batches to Python stay small even where texts are long.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
# The words of the contracts: runs of anything but ASCII white space. These are
# the bytes that bytes.split() takes for white space too.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to the session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return importing(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """``n`` rows of ``rows``, those with the least hash of ``key``; all if there are no more.

    The rows are counted first, so that every task only hands on its share of a
    few more than ``n``, however many tasks there are.
    """
    total = rows.count()
    share = (n + 8 * n**0.5 + 50) / max(total, 1)
    lowest = -(1 << 63)
    rows = rows.withColumn("__hash", F.xxhash64(key))
    if share < 1:
        rows = rows.filter(F.col("__hash") < F.lit(lowest + int(share * (1 << 64))))
    return rows.orderBy("__hash").limit(n).drop("__hash")


def components(edges: DataFrame, stage_as: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """Connected components of the links ``a``, ``b``: one row (node, root) per linked node.

    ``root`` is the smallest node of the component. Alternates the two star steps
    of Kiveris et al.: every node hands its larger, then its smaller neighbours to
    the smallest one it knows. Neighbours are never gathered; a hub is one row per
    link, its minimum is combined before the shuffle. Each round is a written
    table. The rounds grow with the logarithm of the largest component.
    """
    current = stage_as(_links(edges, edges["a"], edges["b"]), "links")
    state = _state(current)
    while state[0]:
        current = stage_as(_star(_star(current, larger=True), larger=False), "links")
        now = _state(current)
        if now == state:
            break
        state = now
    # Every remaining link now leads from a node to its root.
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def _links(rows: DataFrame, a, b) -> DataFrame:
    """Distinct links from the larger node ``a`` to the smaller ``b``."""
    return rows.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()


def _star(links: DataFrame, larger: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The large star looks at all neighbours, the small star at the smaller ones.
    seen = both if larger else links
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("u"), F.least("a", "m").alias("m")
    )
    if larger:
        moved = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("v"), "m")
        return _links(moved, F.col("v"), F.col("m"))
    moved = links.join(least, F.col("a") == F.col("u"))
    return _links(moved.select(F.col("b").alias("v"), "m").unionByName(
        least.select(F.col("u").alias("v"), "m")), F.col("v"), F.col("m"))


def _state(links: DataFrame) -> tuple[int, int]:
    n, total = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(total or 0)
