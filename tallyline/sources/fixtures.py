"""The score tables as views over the star-schema test tables.

Each block is SQL that Spark and DuckDB both run; ``{name}`` stands for another
view or base table. Spark binds those to DataFrames, the checks in
``plans.oracles`` to plain names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.skew import heavy_keys, number_within
from tallyline.session import dropping_shuffles, scratch, shared_folder
from tallyline.sources import sheets

BASE_TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")

BLOCKS: dict[str, str] = {
    "leagues": """
SELECT r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'Hall ' || r_name END AS location,
       'Chair ' || r_name AS contact_name, CASE WHEN r_regionkey % 3 > 0 THEN lower(r_name) || '@league.test' END AS contact_email,
       CASE WHEN r_regionkey = 1 THEN '555-100' END AS contact_phone, 'Mondays' AS schedule_text,
       CASE WHEN r_regionkey > 2 THEN '20 a season' END AS costs_text, r_name || ' league' AS description
FROM {region}""",
    "teams": """
SELECT n_nationkey + 1 AS id, n_name AS name,
       CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_regionkey END AS league_id
FROM {nation}""",
    "team_logos": """
SELECT n_nationkey + 1 AS team_id, 'data:image/png;base64,' || n_name AS logo_data
FROM {nation} WHERE n_nationkey % 4 <> 0""",
    "shooters": """
SELECT s_suppkey AS id, s_nationkey + 1 AS team_id, s_name AS name FROM {supplier}
UNION ALL
SELECT 1000000 + c_custkey, c_nationkey + 1, c_name FROM {customer}
WHERE c_mktsegment = 'MACHINERY'""",
    "rounds": """
SELECT o_orderkey AS id, c_nationkey + 1 AS team_id, CAST(o_orderdate AS DATE) AS round_date,
       CAST(1 + o_orderkey % 2 AS SMALLINT) AS round_number,
       CAST(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 16 + o_orderkey % 12 END AS SMALLINT) AS yardage
FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "scores": """
SELECT round_id, shooter_id, sub_for_shooter_id, station_1, station_2, station_3, station_4, station_5,
       CAST(station_1 + station_2 + station_3 + station_4 + COALESCE(station_5, 0) AS SMALLINT) AS total
FROM (
  SELECT l_orderkey AS round_id, l_suppkey AS shooter_id,
         CASE WHEN l_returnflag = 'R' AND l_partkey % 10 <> l_suppkey THEN l_partkey % 10 END AS sub_for_shooter_id,
         CAST(l_linenumber % 6 AS SMALLINT) AS station_1,
         CAST(CAST(l_quantity AS INT) % 6 AS SMALLINT) AS station_2,
         CAST(CAST(round(l_discount * 100) AS INT) % 6 AS SMALLINT) AS station_3,
         CAST(CAST(round(l_tax * 100) AS INT) % 6 AS SMALLINT) AS station_4,
         CAST(CASE WHEN l_linestatus = 'O' THEN l_partkey % 6 END AS SMALLINT) AS station_5
  FROM {lineitem}) x""",
    "users": """
SELECT c_custkey AS id, lower(c_name) || '@club.test' AS email,
       CASE WHEN c_custkey % 9 = 0 THEN 'g' || CAST(c_custkey AS VARCHAR(20)) END AS google_id,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name,
       CASE WHEN c_custkey % 4 > 0 THEN '555-' || CAST(c_custkey AS VARCHAR(20)) END AS phone,
       c_custkey % 50 = 0 AS is_admin, c_custkey % 20 = 0 AS is_squad_leader,
       c_acctbal >= 0 AS team_approved,
       CASE WHEN c_custkey % 7 = 0 OR c_nationkey % 10 = 4 THEN NULL ELSE c_nationkey + 1 END AS team_id,
       ts AS created_at
FROM {customer} JOIN {events} ON event_id = c_custkey""",
    "submission_headers": """
SELECT id AS submission_id, team_id,
       CASE WHEN id % 211 = 0 THEN 'not-a-date' ELSE CAST(round_date AS VARCHAR(10)) END AS raw_date,
       CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE CAST(yardage AS VARCHAR(4)) END AS raw_yardage,
       CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CAST(round_number AS VARCHAR(4)) END AS raw_round_number
FROM {rounds}""",
    "submission_lines": """
SELECT l_orderkey AS submission_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
       CASE WHEN l_partkey % 20 = 0 THEN '   ' WHEN l_partkey % 5 = 0 THEN '  ' || s_name || ' ' ELSE s_name END AS raw_name,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_linenumber % 6 END AS st1,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_quantity AS INT) % 6 END AS st2,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) % 6 END AS st3,
       CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(round(l_tax * 100) AS INT) % 6 END AS st4,
       CASE WHEN l_partkey % 17 = 0 OR l_linestatus = 'F' THEN NULL ELSE l_partkey % 6 END AS st5,
       CASE WHEN l_partkey % 97 = 0 THEN '20.5'
            WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_quantity AS INT) % 26 AS VARCHAR(4)) END AS raw_total,
       CASE WHEN l_returnflag = 'R' THEN 'Supplier#00000000' || CAST(l_partkey % 10 AS VARCHAR(2))
            WHEN l_returnflag = 'N' AND l_partkey % 3 = 0 THEN ' ' || upper(s_name) END AS raw_sub_for,
       CASE WHEN l_linenumber > 4 THEN 2 END AS row_round_number
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {rounds} r ON r.id = l_orderkey""",
    "raw_extractions": """
SELECT event_id,
       CASE event_id % 5
         WHEN 0 THEN props
         WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
         WHEN 2 THEN 'Looking at it, I see: ' || props || ' Done.'
         WHEN 3 THEN props || ' and {{more}}'
         ELSE 'no json here' END AS raw
FROM {events}""",
    "applicants": """
SELECT c_custkey AS seq,
       CASE WHEN c_custkey % 13 = 0 THEN 'no-at-sign'
            WHEN c_custkey % 5 = 0 THEN '  ' || upper(c_name) || '@Club.Test '
            ELSE 'New' || CAST(c_custkey % 1000 AS VARCHAR(20)) || '@new.test' END AS raw_email,
       CASE WHEN c_custkey % 44 = 0 THEN 999 WHEN c_custkey % 36 = 0 THEN 0 WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 END AS team_id,
       CASE WHEN c_custkey % 3 > 0 THEN ' ' || c_name || ' ' END AS raw_name,
       CASE WHEN c_custkey % 4 = 1 THEN ' Team ' || CAST(c_custkey % 30 AS VARCHAR(4))
            WHEN c_custkey % 4 = 2 AND c_custkey % 10 = 2 THEN n_name END AS new_team_name
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
    "identities": """
SELECT c_custkey AS seq, 'g' || CAST(c_custkey AS VARCHAR(20)) AS external_id,
       CASE WHEN c_custkey % 2 = 0 THEN ' ' || upper(c_name) || '@CLUB.test'
            ELSE 'moved' || CAST(c_custkey AS VARCHAR(20)) || '@new.test' END AS raw_email,
       CASE WHEN c_custkey % 5 > 0 THEN ' ' || c_name END AS raw_name, c_custkey % 17 <> 0 AS email_verified
FROM {customer}
UNION ALL
SELECT 10000000 + c_custkey, 'x' || CAST(c_custkey AS VARCHAR(20)), lower(c_name) || '@club.test', NULL, c_custkey % 14 <> 0
FROM {customer} WHERE c_custkey % 4 < 2
UNION ALL
SELECT 20000000 + c_custkey, 'g' || CAST(c_custkey AS VARCHAR(20)),
       CASE WHEN c_custkey % 2 = 0 THEN lower(c_name) || '@club.test'
            ELSE 'moved' || CAST(c_custkey AS VARCHAR(20)) || '@new.test' END, 'Late ' || c_name, true
FROM {customer} WHERE c_custkey % 8 < 5""",
    "membership_requests": """
SELECT event_id AS seq, user_id,
       CASE event_id % 4 WHEN 0 THEN 'join' WHEN 1 THEN 'create' WHEN 2 THEN 'approve' ELSE 'deny' END AS action,
       CAST(CASE WHEN event_id % 97 = 0 THEN 999 WHEN event_id % 89 = 0 THEN 0 ELSE user_id % 25 + 1 END AS INT) AS team_id,
       CASE WHEN event_id % 4 = 1 AND event_id % 3 > 0
            THEN CASE WHEN event_id % 8 = 1 THEN ' NATION_' || CAST(user_id % 25 AS VARCHAR(2)) || ' '
                      ELSE 'Founded ' || CAST(event_id % 30 AS VARCHAR(2)) END END AS team_name
FROM {events}""",
    "delete_requests": """
SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN user_id - user_id % 50 ELSE user_id END AS requested_by,
       CASE event_id % 7 WHEN 2 THEN 'shooter' WHEN 3 THEN 'user' WHEN 4 THEN 'user' WHEN 5 THEN 'team' WHEN 6 THEN 'league' ELSE 'round' END AS kind,
       CASE event_id % 7 WHEN 2 THEN event_id % 150 WHEN 3 THEN event_id % 400 WHEN 4 THEN user_id % 60 WHEN 5 THEN event_id % 31
            WHEN 6 THEN event_id % 9 ELSE event_id % 5000 END AS id
FROM {events}""",
    "sent_headers": """
SELECT id AS submission_id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 50 = 3 THEN 999999999 ELSE c_custkey END AS user_id,
       CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN r.team_id % 25 + 1 ELSE r.team_id END AS team_id,
       CASE WHEN id % 211 = 0 THEN 'not-a-date' ELSE CAST(round_date AS VARCHAR(10)) END AS raw_date,
       CAST(NULL AS VARCHAR(4)) AS raw_yardage, CAST(round_number AS VARCHAR(4)) AS raw_round_number
FROM {rounds} r JOIN {customer} ON c_custkey = CASE WHEN id % 3 = 0 THEN id % 3 * 50 ELSE id % 140 END""",
}

# The views each block reads, in the order of the blocks above.
NEEDS: dict[str, tuple[str, ...]] = {
    name: tuple(t for t in (*BASE_TABLES, "rounds") if "{" + t + "}" in sql) for name, sql in BLOCKS.items()
}

# Sheet lines before numbering: the sort columns stand in for `pos`.
_LINE_NUMBER = (
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, "
    "l_quantity, l_extendedprice) AS pos"
)
_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


# What was written once so far, by session folder, data folder and name.
_once: dict[tuple[str | None, str, str], Any] = {}


class ClubData:
    """The score tables of one data folder as lazy DataFrames.

    Sheet lines join their round last: the shuffle on the round's key then also
    serves the numbering and everything else that goes sheet by sheet.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._base: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        if table not in self._base:
            self._base[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._base[table]

    def _input(self, name: str) -> DataFrame:
        return self.base(name) if name in BASE_TABLES else getattr(self, name)

    def _view(self, name: str, sql: str | None = None) -> DataFrame:
        return self.spark.sql(sql or BLOCKS[name], **{n: self._input(n) for n in NEEDS[name]})

    leagues = cached_property(lambda self: self._view("leagues"))
    teams = cached_property(lambda self: self._view("teams"))
    team_logos = cached_property(lambda self: self._view("team_logos"))
    shooters = cached_property(lambda self: self._view("shooters"))
    rounds = cached_property(lambda self: self._view("rounds"))
    scores = cached_property(lambda self: self._view("scores"))
    users = cached_property(lambda self: self._view("users"))
    submission_headers = cached_property(lambda self: self._view("submission_headers"))
    raw_extractions = cached_property(lambda self: self._view("raw_extractions"))
    applicants = cached_property(lambda self: self._view("applicants"))
    identities = cached_property(lambda self: self._view("identities"))
    membership_requests = cached_property(lambda self: self._view("membership_requests"))
    delete_requests = cached_property(lambda self: self._view("delete_requests"))
    sent_headers = cached_property(lambda self: self._view("sent_headers"))

    @cached_property
    def submission_lines(self) -> DataFrame:
        sql = BLOCKS["submission_lines"].replace(_LINE_NUMBER, ", ".join(_LINE_ORDER))
        rows = self._view("submission_lines", sql)
        return number_within(
            rows,
            keys=["submission_id"],
            order=[F.col(c) for c in _LINE_ORDER],
            slices=[F.col("l_linenumber"), F.floor(F.col("l_partkey") / 65_536), F.col("l_partkey"), F.col("l_suppkey")],
            name="pos",
            heavy=heavy_keys(self.base("lineitem").withColumnRenamed("l_orderkey", "submission_id"), ["submission_id"]),
        ).drop(*_LINE_ORDER)

    @cached_property
    def documents(self) -> DataFrame:
        """The scoresheets as stored JSON documents (doc). Written once per session and data folder."""
        return self.spark.read.text(self.once("documents", self._write_documents)).withColumnRenamed("value", "doc")

    def _write_documents(self, path: str) -> str:
        with dropping_shuffles(self.spark):
            sheets.sheet_documents(self.submission_headers, self.submission_lines).select("doc").write.text(path, compression="gzip")
        return path

    def once(self, name: str, write: Callable[[str], Any]) -> Any:
        """What ``write`` made of a new folder, the first time it was asked for in this session and data folder."""
        key = (shared_folder(self.spark), self.folder, name)
        if key not in _once:
            _once[key] = write(scratch(self.spark, name, keep=True))
        return _once[key]
