"""Whole queries on tables where single keys hold a third of the rows."""

import pathlib
import shutil

import pytest

import __spark_entry__ as contract
from tallyline.operators import reads, skew
from tests.compare import database, difference
from tests.conftest import FOLDER

THIRDS = {
    "lineitem": """SELECT * REPLACE (
        CASE WHEN l_partkey % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey,
        CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey)""",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey)",
    "customer": "SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE c_nationkey END AS c_nationkey)",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, con):
    folder = tmp_path_factory.mktemp("skewed")
    for source in pathlib.Path(FOLDER).glob("*.parquet"):
        if source.stem in THIRDS:
            con.execute(f"COPY ({THIRDS[source.stem]} FROM '{source}') TO '{folder}/{source.name}' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
        else:
            shutil.copyfile(source, folder / source.name)
    return str(folder)


@pytest.mark.parametrize(
    "name", ["team_leaderboard", "shooter_trends", "round_history", "normalised_lines", "explode_scoresheets", "facts_after_ingest"]
)
def test_heavy_keys_give_the_same_results(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(skew, "HEAVY_ROWS", 100)
    assert difference(spark, database(skewed), skewed, name) is None


@pytest.fixture
def eager_splits(spark):
    """No broadcasts, and partitions count as skewed from a few kilobytes on."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        # Several map tasks, as for a large table: a partition is split along them.
        "spark.sql.files.maxPartitionBytes": "30KB",
        "spark.sql.files.openCostInBytes": "1KB",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["team_leaderboard", "split_rounds", "rejected_submissions", "history_labels"])
def test_skewed_joins_are_split(spark, skewed, eager_splits, name):
    assert difference(spark, database(skewed), skewed, name) is None
    frame = contract.queries()[name](spark, skewed)
    frame.collect()
    assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()


def test_pages_of_a_heavy_round_are_bounded(spark, skewed):
    from tallyline.sources.fixtures import ClubData

    d = ClubData(spark, skewed)
    pages = reads.round_history(d.scores, d.shooters, d.rounds, page_rows=50, heavy_rows=100)
    sizes = pages.selectExpr("id", "json_array_length(shooters) AS n")
    assert sizes.agg({"n": "max"}).first()[0] == 50
    assert sizes.agg({"n": "sum"}).first()[0] == d.scores.count()
