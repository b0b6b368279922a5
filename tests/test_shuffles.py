"""What is shuffled, and how much of it one task takes."""

import pytest
from pyspark.sql import functions as F

from tallyline import session
from tallyline.operators import ingest, reads
from tallyline.operators.skew import heavy_keys, number_within
from tallyline.sources import layout
from tallyline.sources.tables import SCHEMAS


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_numbering_and_grouping_share_one_shuffle(spark, no_broadcast, tmp_path):
    spark.range(500).selectExpr("id % 7 AS k", "id * 37 % 101 AS a", "concat('n', id) AS text").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    a = F.col("a")
    numbered = number_within(rows, ["k"], [a, F.col("text")], [a], "n", heavy_keys(rows, ["k"], 1_000))
    found = numbered.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("l"))
    lines = plan(found).split("\n")
    first = next(k for k, x in enumerate(lines) if "FileScan" in x and "text" in x)
    assert len([x for x in lines[:first] if "Exchange hashpartitioning" in x]) == 1
    assert sorted(x.n for r in found.collect() if r.k == 3 for x in r.l) == list(range(1, 72))


def people(spark, tmp_path):
    scores = [(r, s, 3 if s == 1 else None, 1, 2, 3, 4, 5, 15) for r in range(4) for s in range(3)]
    out = {
        "scores": spark.createDataFrame(scores, SCHEMAS["scores"]),
        "shooters": spark.createDataFrame([(s, 1, f"n{s}") for s in range(4)], SCHEMAS["shooters"]),
        "rounds": spark.createDataFrame([(r, 1, None, 1, 16) for r in range(4)], SCHEMAS["rounds"]),
        "teams": spark.createDataFrame([(1, "t", None)], SCHEMAS["teams"]),
    }
    for name, rows in out.items():
        rows.write.parquet(str(tmp_path / name))
    return [spark.read.schema(SCHEMAS[name]).parquet(str(tmp_path / name)) for name in out]


def test_only_substitutes_are_shuffled_for_whom_they_replaced(spark, no_broadcast, tmp_path):
    scores, shooters, rounds, teams = people(spark, tmp_path)
    detail = reads.round_detail(scores, shooters, rounds, teams)
    text = plan(detail)
    shuffled = [x for x in text.split("\n") if "Exchange hashpartitioning(sub_for_shooter_id" in x]
    assert len(shuffled) == 1 and "IsNotNull(sub_for_shooter_id)" in text and "IsNull(sub_for_shooter_id)" in text
    assert {(r.shooter_id, r.sub_for_name, r.team_name) for r in detail.collect()} == {(0, None, "t"), (1, "n3", "t"), (2, None, "t")}
    assert detail.count() == 12


def test_only_lines_with_a_substitute_are_shuffled_for_its_name(spark, no_broadcast, tmp_path):
    spark.createDataFrame(
        [(1, 1, 5, "a", None), (1, 2, 5, "b", "a"), (1, 3, 5, "a", "x"), (1, 4, 6, "a", None)],
        "submission_id BIGINT, pos BIGINT, team_id INT, name STRING, sub_for STRING",
    ).write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    roster = spark.createDataFrame([(10, 5, "a"), (11, 5, "b"), (12, 6, "b")], "id BIGINT, team_id INT, name STRING")
    found = ingest.resolve_names(lines, roster)
    assert "IsNull(sub_for)" in plan(found)
    assert sorted((r.pos, r.shooter_id, r.sub_for_shooter_id) for r in found.collect()) == [(1, 10, None), (2, 11, 10), (3, 10, None)]


def test_partitions_are_small_unless_the_session_names_a_size(spark):
    key, number = session.SIZES
    before = spark.conf.get(key)
    try:
        for given, kept in ((None, session.SIZES[key]), ("3m", "3m")):
            spark.conf.set(key, given) if given else spark.conf.unset(key)
            session.prepare(spark)
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, before)
    assert int(spark.conf.get(number)) == 600


def test_buckets_grow_with_the_scores(spark):
    rows = spark.range(100)
    assert layout.buckets_for(rows, 30) == 4
    assert layout.buckets_for(rows.union(rows), 30) == 7
    assert layout.buckets_for(rows) == 2
