"""Statistics shown next to the leaderboards: summaries, drilldowns, accuracy, badges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.functions.exprs import exact_avg, iso_date
from tallyline.operators.directory import squad_leaders
from tallyline.operators.reads import (
    STATIONS,
    in_order,
    round_keys,
    score_lines,
    shooter_totals,
    team_totals,
    top_by_points,
    with_logo,
)

TARGETS_PER_STATION = 5
TREND_SHOOTERS = 5


def _team_shooter_sums(scores: DataFrame, rounds: DataFrame, *extra) -> DataFrame:
    """Scores added up per (team of the round, shooter)."""
    return (
        scores.join(round_keys(rounds, "team_id"), "round_id")
        .groupBy("team_id", "shooter_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("points"), F.max("total").alias("best"), *extra)
    )


def team_summary(scores: DataFrame, rounds: DataFrame, teams: DataFrame) -> DataFrame:
    """Rounds logged, active shooters, average and best score of every team."""
    logged = rounds.groupBy("team_id").agg(F.count(F.lit(1)).alias("rounds_logged"))
    shot = (
        _team_shooter_sums(scores, rounds)
        .groupBy("team_id")
        .agg(
            F.count(F.lit(1)).alias("active_shooters"),
            exact_avg(F.sum("points"), F.sum("n"), 1).alias("team_average"),
            F.max("best").cast("int").alias("best_round"),
        )
    )
    return (
        teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
        .join(logged, "team_id", "left")
        .join(shot, "team_id", "left")
        .na.fill(0, ["rounds_logged", "active_shooters"])
    )


def team_trends_top5(
    scores: DataFrame, shooters: DataFrame, rounds: DataFrame, k: int = TREND_SHOOTERS
) -> DataFrame:
    """Trend points of the ``k`` names with the most scores in each team's rounds.

    Ranking runs on one row per (team, name); only ``k`` rows per team and task
    survive to the shuffle. The second pass keeps the scores of the chosen
    shooters, at most ``k`` names per team, before it looks up any round.
    """
    pairs = (
        scores.join(round_keys(rounds, "team_id"), "round_id")
        .groupBy("team_id", "shooter_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(shooters.select(F.col("id").alias("shooter_id"), "name"), "shooter_id")
    )
    rank = F.row_number().over(W.partitionBy("team_id").orderBy(F.desc("n"), "name"))
    names = pairs.groupBy("team_id", "name").agg(F.sum("n").alias("n")).withColumn("rank", rank)
    top = names.filter(F.col("rank") <= k).select("team_id", "name", "rank")
    ids = pairs.select("team_id", "shooter_id", "name").join(top, ["team_id", "name"])
    dates = round_keys(rounds, "team_id", "round_date", "round_number")
    return (
        scores.select("round_id", "shooter_id", "total")
        .join(ids.select("shooter_id"), "shooter_id", "left_semi")
        .join(dates, "round_id")
        .join(ids, ["team_id", "shooter_id"])
        .select("team_id", "rank", "name", iso_date("round_date").alias("round_date"), "round_number", "round_id", "total")
    )


def shooter_drilldown(scores: DataFrame, shooters: DataFrame) -> DataFrame:
    """Per shooter: rounds, average, best and hit rate of every station."""
    sums = scores.groupBy("shooter_id").agg(
        F.count(F.lit(1)).alias("rounds"),
        F.count("sub_for_shooter_id").alias("rounds_as_sub"),
        exact_avg(F.sum("total"), F.count(F.lit(1)), 1).alias("avg_total"),
        F.max("total").cast("int").alias("best_total"),
        *[exact_avg(F.sum(s), TARGETS_PER_STATION * F.count(s), 3).alias(f"accuracy_{s[-1]}") for s in STATIONS],
    )
    return sums.join(shooters.select(F.col("id").alias("shooter_id"), "name", "team_id"), "shooter_id")


def shooter_history(
    scores: DataFrame, shooters: DataFrame, rounds: DataFrame, shooter_id: int | None = None
) -> DataFrame:
    """Every score of every shooter (or of one, oldest first), tagged when shot for someone else."""
    if shooter_id is not None:
        scores = scores.filter(F.col("shooter_id") == shooter_id)
    history = score_lines(scores, shooters, rounds).select(
        "shooter_id", "name", "team_id", iso_date("round_date").alias("round_date"), "round_number", "round_id",
        *STATIONS, "total", F.col("sub_for_shooter_id").isNotNull().alias("is_sub"), "sub_for_name",
    )
    return in_order(history, shooter_id is not None, "round_date", "round_number", "round_id")


def station_accuracy(scores: DataFrame, rounds: DataFrame) -> DataFrame:
    """Hit rate of each station, per team and per shooter.

    Hits and attempts are summed in wide form first; the five stations become
    rows only on the (team, shooter) sums.
    """
    wide = _team_shooter_sums(
        scores,
        rounds,
        *[F.sum(s).alias(f"hits_{i}") for i, s in enumerate(STATIONS, 1)],
        *[F.count(s).alias(f"shots_{i}") for i, s in enumerate(STATIONS, 1)],
    )
    stack = ", ".join(f"{i}, hits_{i}, shots_{i}" for i in range(1, len(STATIONS) + 1))
    long = wide.select("team_id", "shooter_id", F.expr(f"stack({len(STATIONS)}, {stack}) AS (station, hits, shots)"))
    sets = [[F.col("team_id"), F.col("station")], [F.col("shooter_id"), F.col("station")]]
    grouped = long.groupingSets(sets, F.col("team_id"), F.col("shooter_id"), F.col("station")).agg(
        F.sum("hits").alias("hits"), F.sum("shots").alias("shots"), F.grouping("shooter_id").alias("by_team")
    )
    by_team = F.col("by_team") == 1
    return grouped.select(
        F.when(by_team, "team").otherwise("shooter").alias("scope"),
        F.when(by_team, F.col("team_id").cast("bigint")).otherwise(F.col("shooter_id")).alias("scope_id"),
        "station",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        "shots",
        exact_avg("hits", TARGETS_PER_STATION * F.col("shots"), 3).alias("accuracy"),
    )


def leader_callouts(
    scores: DataFrame, shooters: DataFrame, rounds: DataFrame, teams: DataFrame, logos: DataFrame
) -> DataFrame:
    """The leading shooter and the leading team of the site, with the team's logo."""
    person = top_by_points(shooter_totals(scores, shooters, teams), "id", 1).select(
        F.lit("individual").alias("kind"), "id", "name", "team_id", "total_points", "rounds"
    )
    team = top_by_points(team_totals(scores, rounds, teams), "team_id", 1).select(
        F.lit("team").alias("kind"), F.col("team_id").cast("bigint").alias("id"), "name", "team_id",
        "total_points", "rounds",
    )
    return with_logo(person.unionByName(team), logos, "logo").select(
        "kind", "id", "name", "team_id", "logo", "total_points", "rounds"
    )


def next_round_number(rounds: DataFrame) -> DataFrame:
    """The number to suggest for another round of a team on a day it already shot."""
    return rounds.groupBy("team_id", "round_date").agg((F.count(F.lit(1)) + 1).alias("next_number")).select(
        "team_id", iso_date("round_date").alias("round_date"), "next_number"
    )


def badged_shooters(shooters: DataFrame, users: DataFrame) -> DataFrame:
    """Roster with a flag on names that belong to a squad leader of the same team."""
    leaders = squad_leaders(users).distinct().withColumn("badge", F.lit(True))
    return shooters.join(leaders, ["name", "team_id"], "left").select(
        "id", "team_id", "name", F.coalesce("badge", F.lit(False)).alias("is_squad_leader")
    )


def leagues_for_member(leagues: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    """The league pinned on top of each account's league list.

    The rest of the list is ``league_directory`` without that league, the same
    for everybody, so it is not repeated per account.
    """
    own = teams.select(F.col("id").alias("team_id"), "league_id")
    named = leagues.select(F.col("id").alias("league_id"), F.col("name").alias("pinned_league"))
    return (
        users.select(F.col("id").alias("user_id"), "team_id")
        .join(own, "team_id", "left")
        .join(named, "league_id", "left")
        .select("user_id", F.col("league_id").alias("pinned_league_id"), "pinned_league")
    )


def league_lists(leagues: DataFrame, teams: DataFrame) -> DataFrame:
    """The full league list as the members of each team see it: their own league first, then by name.

    One list per distinct own league (NULL for teams without one), not per member.
    ``place`` is the position. Leagues number a handful, so a list is one array.
    """
    entry = F.struct(F.col("name"), F.col("id"))
    everything = leagues.agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    owners = teams.select(F.col("league_id").alias("own_league_id")).distinct()
    listed = owners.withColumn("entries", everything.scalar())
    own = F.filter("entries", lambda e: e["id"] == F.coalesce("own_league_id", F.lit(-1)))
    others = F.filter("entries", lambda e: e["id"] != F.coalesce("own_league_id", F.lit(-1)))
    placed = listed.select("own_league_id", F.posexplode(F.concat(own, others)).alias("place", "e"))
    return placed.select(
        "own_league_id", (F.col("place") + 1).alias("place"), F.col("e.id").alias("league_id"), F.col("e.name").alias("name")
    )


def history_labels(scores: DataFrame, shooters: DataFrame, rounds: DataFrame) -> DataFrame:
    """Names as the history shows them: an asterisk and a tag on substitute appearances."""
    is_sub = F.col("sub_for_shooter_id").isNotNull()
    return score_lines(scores, shooters, rounds).select(
        "round_id",
        "team_id",
        "shooter_id",
        F.when(is_sub, F.concat("name", F.lit("*"))).otherwise(F.col("name")).alias("label"),
        F.when(is_sub, F.concat(F.lit("SUB for "), "sub_for_name")).alias("tag"),
        "total",
    )
