"""The stored layout and files of several ages."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tallyline.operators import maintain, reads
from tallyline.plans import catalog
from tallyline.sources import layout, tables


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def club(spark, tmp_path_factory):
    """Rounds of three months, one without a date and one without a team, and a score of no stored round."""
    day = datetime.date
    rounds = [(k, k % 3 + 1, day(2024, 1 + k % 3, 1 + k % 27), 1, 16) for k in range(40)] + [(90, 1, None, 1, None), (91, None, day(2024, 2, 2), 1, None)]
    scores = [(r, s, None, 1, 2, 3, 4, 5, 15 + (r + s) % 10) for r, *_ in rounds for s in range(3)] + [(999, 1, None, 0, 0, 0, 0, 0, 7)]
    return (
        spark.createDataFrame(rounds, tables.SCHEMAS["rounds"]), spark.createDataFrame(scores, tables.SCHEMAS["scores"]),
        spark.createDataFrame([(s, 1, f"n{s}") for s in range(3)], tables.SCHEMAS["shooters"]),
    )


def stored(spark, club, folder, by, name, buckets=4):
    own = layout.Layout(spark, str(folder / "it's here"), name, by, buckets).attach()
    own.write(club[0], club[1])
    return own


def contents(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("by", [layout.MONTH, layout.TEAM])
def test_everything_is_kept(spark, club, tmp_path, by):
    own = stored(spark, club, tmp_path, by, f"kept_{by}")
    assert contents(own.read("rounds")) == contents(club[0])
    assert contents(own.read("scores")) == contents(club[1])
    board = reads.team_leaderboard(own.read("scores"), club[2], own.read("rounds"))
    assert contents(board) == contents(reads.team_leaderboard(club[1], club[2], club[0]))
    own.detach()


def above(text: str, line: str) -> list[str]:
    """The operators of a plan over the one whose line has ``line``, the nearest first."""
    lines = text.split("\n")
    at = next(k for k, x in enumerate(lines) if line in x)
    depth = lambda x: re.search("[A-Z(*]", x).start()
    out, level = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if x.strip() and depth(x) < level:
            out.append(x)
            level = depth(x)
    return out


def summed_in_place(text: str, scan: str) -> bool:
    """Whether what a scan reads is added up before anything is shuffled."""
    up = above(text, scan)
    summed = next(k for k, x in enumerate(up) if "partial_sum" in x)
    return any("Join" in x for x in up[:summed]) and not any("Exchange" in x for x in up[:summed])


def test_scores_are_not_shuffled(spark, club, tmp_path, no_broadcast):
    own = stored(spark, club, tmp_path, layout.MONTH, "in_place")
    text = plan(reads.team_leaderboard(own.read("scores"), club[2], own.read("rounds")))
    assert summed_in_place(text, "default.in_place_scores") and summed_in_place(text, "default.in_place_rounds")
    assert not summed_in_place(plan(reads.team_leaderboard(club[1], club[2], club[0])), "sub_for_shooter_id")
    own.detach()


def scanned(frame) -> list[tuple[str, str]]:
    """(table, its partition filters) of every scan."""
    return re.findall(r"FileScan parquet spark_catalog\.default\.(\w+).*?PartitionFilters: \[(.*?)\], ", plan(frame))


def test_one_month_or_team_is_one_partition(spark, club, tmp_path, no_broadcast):
    own = stored(spark, club, tmp_path, layout.MONTH, "pruned_month")
    month = reads.site_trends(own.read("scores", month=202402), own.read("rounds", month=202402))
    assert {t for t, f in scanned(month) if "= 202402" in f} == {"pruned_month_rounds", "pruned_month_scores"}
    assert {r["date"][:7] for r in month.collect()} == {"2024-02"}
    folders = {p.parent.name for p in (tmp_path / "it's here").rglob("*.parquet")}
    assert folders == {"month=202401", "month=202402", "month=202403", "month=__HIVE_DEFAULT_PARTITION__"}
    own.detach()

    team = stored(spark, club, tmp_path / "t", layout.TEAM, "pruned_team")
    board = reads.team_leaderboard(team.read("scores", team_id=2), club[2], team.read("rounds", team_id=2), team_id=2)
    part = spark.range(1).select(layout.team_part(F.lit(2).cast("int"))).first()[0]
    assert {t for t, f in scanned(board) if f"= {part})" in f} == {"pruned_team_rounds", "pruned_team_scores"}
    assert contents(board) == contents(reads.team_leaderboard(club[1], club[2], club[0], team_id=2))
    with pytest.raises(ValueError):
        team.read("rounds", month=202402)
    team.detach()


def test_only_given_partitions_are_replaced(spark, club, tmp_path):
    own = stored(spark, club, tmp_path, layout.MONTH, "replaced")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "it's here").rglob("*.parquet") if "202402" not in str(p)}
    new_rounds = spark.createDataFrame([(500, 1, datetime.date(2024, 2, 9), 2, 20)], tables.SCHEMAS["rounds"])
    new_scores = spark.createDataFrame([(500, 1, None, 1, 1, 1, 1, 1, 5)], tables.SCHEMAS["scores"])
    own.write(new_rounds, new_scores)
    kept = club[0].filter("round_date IS NULL OR month(round_date) <> 2")
    assert contents(own.read("rounds")) == contents(kept.unionByName(new_rounds))
    assert [r["round_id"] for r in own.read("scores", month=202402).collect()] == [500]
    assert {p: p.stat().st_mtime_ns for p in before} == before
    own.detach()
    # The tables come back with their partitions.
    again = layout.Layout(spark, str(tmp_path / "it's here"), "again", layout.MONTH, 4).attach()
    assert again.read("rounds").count() == kept.count() + 1
    again.detach()


def test_stored_leaderboard_has_no_exchange_of_scores(data, no_broadcast):
    text = plan(catalog.stored_leaderboard(data))
    assert summed_in_place(text, "_scores[")


# --- files of several ages -------------------------------------------------------------


def old_and_new(spark, folder):
    """Rounds from before yardages, from before round numbers, and of today, one of these with a NULL number."""
    day = datetime.date(2024, 1, 1)
    spark.createDataFrame([(1, day, 7)], "id INT, round_date DATE, team_id INT").write.mode("append").parquet(folder)
    spark.createDataFrame([(2, 1, day, 21)], "id BIGINT, team_id INT, round_date DATE, yardage SMALLINT").repartition(2).write.mode("append").parquet(folder)
    new = [(3, 1, day, 4, 16), (4, 1, day, None, None)]
    spark.createDataFrame(new, tables.SCHEMAS["rounds"]).repartition(2).write.mode("append").parquet(folder)
    return day


def test_defaults_go_to_rows_from_before_the_column(spark, tmp_path):
    folder = str(tmp_path / "rounds")
    day = old_and_new(spark, folder)
    found = tables.read_generations(spark, folder, "rounds", lambda old: maintain.added_columns(old, "rounds"))
    assert sorted(map(tuple, found.collect())) == [(1, 7, day, 1, None), (2, 1, day, 1, 21), (3, 1, day, 4, 16), (4, 1, day, None, None)]
    assert found.schema == spark.createDataFrame([], tables.SCHEMAS["rounds"]).schema
    plain = tables.read_generations(spark, folder, "rounds")
    assert {r["id"]: r["round_number"] for r in plain.collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_filters_on_a_later_column_skip_older_files(spark, tmp_path):
    folder = str(tmp_path / "rounds")
    old_and_new(spark, folder)
    found = tables.read_generations(spark, folder, "rounds", lambda old: maintain.added_columns(old, "rounds"))
    assert plan(found.filter("round_number = 4")).count("FileScan") == 1
    assert [r["id"] for r in found.filter("round_number = 4").collect()] == [3]


def test_one_footer_is_read_per_job(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "rounds")
    old_and_new(spark, folder)
    (tmp_path / "empty").mkdir()
    found = tables._write_jobs(spark, folder).values()
    assert len(found) == 3 and sum(map(len, found)) == len(list((tmp_path / "rounds").glob("*.parquet")))
    assert tables.read_generations(spark, str(tmp_path / "empty"), "rounds").count() == 0
