"""The stored tables: schemas and readers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "leagues": (
        "id INT, name STRING, location STRING, contact_name STRING, contact_email STRING, contact_phone STRING, "
        "schedule_text STRING, costs_text STRING, description STRING"
    ),
    "teams": "id INT, name STRING, league_id INT",
    "team_logos": "team_id INT, logo_data STRING",
    "users": (
        "id BIGINT, email STRING, google_id STRING, name STRING, phone STRING, address STRING, is_admin BOOLEAN, "
        "is_squad_leader BOOLEAN, team_approved BOOLEAN, team_id INT, created_at TIMESTAMP_NTZ"
    ),
    "shooters": "id BIGINT, team_id INT, name STRING",
    "rounds": "id BIGINT, team_id INT, round_date DATE, round_number SMALLINT, yardage SMALLINT",
    "scores": (
        "round_id BIGINT, shooter_id BIGINT, sub_for_shooter_id BIGINT, station_1 SMALLINT, station_2 SMALLINT, "
        "station_3 SMALLINT, station_4 SMALLINT, station_5 SMALLINT, total SMALLINT"
    ),
}


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stored table; columns that older files lack read as NULL (with defaults: ``read_generations``)."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder.rstrip('/')}/{table}")


def _write_jobs(spark: SparkSession, folder: str) -> dict[tuple[str, str], list[str]]:
    """The Parquet files below ``folder`` by the job that wrote them.

    A job's files are in one folder and differ by their task number; any other file
    counts as a job of its own.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    jobs: dict[tuple[str, str], list[str]] = {}
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().endswith(".parquet"):
            job = re.sub(r"^part-\d+", "part", path.getName())
            jobs.setdefault((path.getParent().toString(), job), []).append(path.toString())
    return jobs


def read_generations(
    spark: SparkSession, folder: str, table: str, upgrade: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """A stored table whose files are of several ages, with the columns and types of SCHEMAS.

    Files with the same columns are one generation. ``upgrade`` gets each of them with
    just the columns it has and adds what it lacks; without it that is NULL. So a
    default goes to rows from before a column was there, never to a NULL in a file
    that has it. One footer is read for every job that wrote here. A filter on a column
    that a generation lacks is decided without reading its files. An empty folder is an empty table.
    """
    generations: dict[tuple[tuple[str, str], ...], list[str]] = {}
    for files in _write_jobs(spark, folder).values():
        columns = tuple(sorted(spark.read.parquet(files[0]).dtypes))
        generations.setdefault(columns, []).extend(files)
    wanted = spark.createDataFrame([], SCHEMAS[table])
    kinds = dict(wanted.dtypes)
    for columns, files in sorted(generations.items()):
        own = ", ".join(f"`{name}` {kind}" for name, kind in columns if name in kinds)
        rows = spark.read.schema(own).parquet(*sorted(files))
        rows = rows if upgrade is None else upgrade(rows)
        missing = {c: F.lit(None) for c in kinds if c not in rows.columns}
        wanted = wanted.unionByName(rows.withColumns(missing).select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]))
    return wanted


def read_jdbc(
    spark: SparkSession, url: str, table: str, partitions: int, lower: int, upper: int, key: str | None = None, **options: str
) -> DataFrame:
    """A table of a live database, read in parallel ranges of its id.

    ``lower`` and ``upper`` only place the range cuts; rows outside still come in.
    """
    if key is None:
        key = "round_id" if table == "scores" else "id"
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, numPartitions=str(partitions),
            lowerBound=str(lower), upperBound=str(upper), **options,
        )
        .load()
    )
