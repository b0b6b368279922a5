"""Rounds and scores stored for the way they are read: partitioned by month, year or team, bucketed by round.

A round and its scores are in the same partition and bucket, so they meet without a
shuffle, and a read of one month or one team lists only its partition. New versions
of whole partitions replace the old ones and leave all others alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.sources.store import Files
from tallyline.sources.tables import SCHEMAS

MONTH, YEAR, TEAM = "month", "year", "team"
#: Partitions that teams are dealt into; a team is in one, which it shares with others.
TEAM_PARTS = 16
#: Scores that one task reads and sorts: a bucket should hold no more of them.
BUCKET_ROWS = 2_000_000
#: Bucket column of each table: the round.
KEYS = {"rounds": "id", "scores": "round_id"}
_KINDS = {MONTH: "month INT", YEAR: "year INT", TEAM: "team_part INT"}


def month_of(date: str | Column) -> Column:
    """2024-05-31 is in month 202405."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


def team_part(team: str | Column, parts: int = TEAM_PARTS) -> Column:
    return F.pmod(F.xxhash64(F.col(team) if isinstance(team, str) else team), F.lit(parts)).cast("int")


def buckets_for(scores: DataFrame, bucket_rows: int = BUCKET_ROWS, least: int = 2) -> int:
    """Buckets for so many scores, so that one keeps its size however many there are."""
    return max(least, -(-scores.count() // bucket_rows))


class Layout:
    """Two catalog tables, ``<name>_rounds`` and ``<name>_scores``, over folders below ``path``.

    ``by`` is MONTH, YEAR or TEAM. ``buckets`` stays what it was when the tables were first
    written; a bucket is read by one task, so it should fit one (``buckets_for``). Rounds without a date or team are in a partition of their own, and so
    are scores without a stored round.
    """

    def __init__(
        self, spark: SparkSession, path: str, name: str, by: str = MONTH, buckets: int = 8, parts: int = TEAM_PARTS
    ):
        if by not in _KINDS:
            raise ValueError(f"{by!r} is none of {', '.join(_KINDS)}")
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"{name!r} is no table name")
        self.spark, self.path, self.name, self.by, self.buckets, self.parts = spark, path.rstrip("/"), name, by, buckets, parts
        self.column = _KINDS[by].split()[0]

    def table(self, kind: str) -> str:
        return f"{self.name}_{kind}"

    def attach(self) -> Layout:
        """Declare the tables to the session's catalog, with the partitions that are there already."""
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        files = Files(self.spark, self.path)
        for kind, key in KEYS.items():
            files.make(f"{self.path}/{kind}")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.table(kind)} ({SCHEMAS[kind]}, {_KINDS[self.by]}) USING parquet "
                f"PARTITIONED BY ({self.column}) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{place}/{kind}'"
            )
            self.spark.sql(f"MSCK REPAIR TABLE {self.table(kind)}")
        return self

    def detach(self) -> None:
        """Take the tables out of the catalog; the files stay."""
        for kind in KEYS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(kind)}")

    def _placed(self, rounds: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
        """Both tables with the partition of their round."""
        of = {MONTH: month_of("round_date"), YEAR: F.year("round_date"), TEAM: team_part("team_id", self.parts)}
        place = F.when(F.col("team_id" if self.by == TEAM else "round_date").isNotNull(), of[self.by])
        placed = rounds.withColumn(self.column, place)
        of_round = placed.select(F.col("id").alias("__round"), F.col(self.column))
        lines = scores.join(of_round, scores["round_id"] == F.col("__round"), "left").drop("__round")
        return {"rounds": placed, "scores": lines}

    def write(self, rounds: DataFrame, scores: DataFrame) -> None:
        """Replace every partition that has a row in ``rounds`` or ``scores`` by these rows; all others stay.

        What is given must be the whole new content of its partitions. Rows are dealt by
        bucket; where a round or month holds a large share of them, several tasks write
        one bucket.
        """
        for kind, rows in self._placed(rounds, scores).items():
            names = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
            bucket = F.pmod(F.hash(KEYS[kind]), F.lit(self.buckets))
            dealt = rows.select(*names, self.column).withColumn("__bucket", bucket).hint("rebalance", "__bucket").drop("__bucket")
            before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            try:
                dealt.write.mode("overwrite").insertInto(self.table(kind))
            finally:
                self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)

    def read(
        self, kind: str, month: int | None = None, year: int | None = None, team_id: int | None = None
    ) -> DataFrame:
        """A stored table, of one month (like 202405), year or team only where it is partitioned so."""
        rows = self.spark.table(self.table(kind))
        for by, value in ((MONTH, month), (YEAR, year)):
            if value is not None:
                self._needs(by)
                rows = rows.filter(F.col(self.column) == value)
        if team_id is not None:
            self._needs(TEAM)
            rows = rows.filter(F.col("team_part") == team_part(F.lit(team_id).cast("int"), self.parts))
            if kind == "rounds":
                rows = rows.filter(F.col("team_id") == team_id)
        return rows.drop(self.column)

    def _needs(self, by: str) -> None:
        if self.by != by:
            raise ValueError(f"{self.name} is partitioned by {self.by}")
