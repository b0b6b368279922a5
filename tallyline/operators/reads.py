"""Leaderboards, trends, scoreboards and histories over the score table.

Every function answers all teams at once; ``team_id`` narrows it to one team
before anything is joined. Scores are added up by their own ids before they
meet another table, so a round or shooter with a large share of the rows is
already small when it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.exprs import exact_avg, iso_date, spread_null_id
from tallyline.operators.skew import heavy_keys, number_within
from tallyline.session import stage

STATIONS = [f"station_{i}" for i in range(1, 6)]
TOP_K = 10
# Points or score lines in one JSON document; longer lists go on to further pages.
PAGE_ROWS = 10_000


def _of_team(rounds: DataFrame, team_id: int | None) -> DataFrame:
    return rounds if team_id is None else rounds.filter(F.col("team_id") == team_id)


def round_keys(rounds: DataFrame, *columns: str) -> DataFrame:
    return rounds.select(F.col("id").alias("round_id"), *columns)


def in_order(rows: DataFrame, narrowed: bool, *columns: str | Column) -> DataFrame:
    """Sort rows of one team, round or shooter for display.

    Row-level results over all teams stay unsorted: a total order over the whole
    site would cost a second pass and a shuffle that no reader needs.
    """
    return rows.orderBy(*columns) if narrowed else rows


def _named(shooters: DataFrame, id_name: str, name: str) -> DataFrame:
    return shooters.select(F.col("id").alias(id_name), F.col("name").alias(name))


def score_lines(
    scores: DataFrame,
    shooters: DataFrame,
    rounds: DataFrame,
    team_id: int | None = None,
    round_columns: Sequence[str] = ("team_id", "round_date", "round_number", "yardage"),
) -> DataFrame:
    """Every score with its round, the name of who shot, and who was subbed for.

    Only substitutes' scores are shuffled to look up whom they stood in for. Rounds come
    last, so that their values are not shuffled with the scores.
    """
    rounds = _of_team(rounds, team_id)
    if team_id is not None:
        scores = scores.join(round_keys(rounds), "round_id", "left_semi")
    subbed = _named(shooters, "subbed_id", "sub_for_name")
    own = scores.filter("sub_for_shooter_id IS NULL").withColumn("sub_for_name", F.lit(None).cast("string"))
    subs = scores.filter("sub_for_shooter_id IS NOT NULL").join(subbed, F.col("sub_for_shooter_id") == F.col("subbed_id"), "left")
    return (
        own.unionByName(subs.drop("subbed_id"))
        .join(_named(shooters, "shooter_id", "name"), "shooter_id")
        .join(round_keys(rounds, *round_columns), "round_id")
    )


def team_leaderboard(
    scores: DataFrame, shooters: DataFrame, rounds: DataFrame, team_id: int | None = None
) -> DataFrame:
    """Per team and member: rounds, average, best and station averages.

    A substitute's score counts for the member they stood in for. Sums are built
    per (team, shooter, subbed member) before names are looked up; unknown ids
    fall out or fall back exactly as they would row by row.
    """
    teams = round_keys(_of_team(rounds, team_id), "team_id")
    sums = [
        F.count(F.lit(1)).alias("n"),
        F.sum("total").alias("points"),
        F.max("total").alias("best"),
        *[F.sum(s).alias(f"{s}_sum") for s in STATIONS],
        *[F.count(s).alias(f"{s}_n") for s in STATIONS],
    ]
    pairs = scores.join(teams, "round_id").groupBy("team_id", "shooter_id", "sub_for_shooter_id").agg(*sums)

    subbed = _named(shooters, "subbed_id", "subbed_name")
    credited = (
        pairs.join(_named(shooters, "shooter_id", "name"), "shooter_id")
        .join(subbed, spread_null_id("sub_for_shooter_id", "team_id", "shooter_id") == F.col("subbed_id"), "left")
        .withColumn("subbed_n", F.when(F.col("sub_for_shooter_id").isNotNull(), F.col("n")).otherwise(0))
        .withColumn("shooter_id", F.coalesce("subbed_id", "shooter_id"))
        .withColumn("name", F.coalesce("subbed_name", "name"))
    )
    return (
        credited.groupBy("team_id", "shooter_id", "name")
        .agg(
            F.sum("n").alias("rounds"),
            F.sum("subbed_n").alias("subbed_rounds"),
            exact_avg(F.sum("points"), F.sum("n"), 1).alias("avg_total"),
            F.max("best").cast("int").alias("best_total"),
            *[exact_avg(F.sum(f"{s}_sum"), F.sum(f"{s}_n"), 2).alias(f"avg_{s}") for s in STATIONS],
        )
        .orderBy("team_id", F.desc("avg_total"), "shooter_id")
    )


def trend_points(
    scores: DataFrame, shooters: DataFrame, rounds: DataFrame, team_id: int | None = None
) -> DataFrame:
    """One point per score under the name of who shot; substitutes are never rolled up."""
    dates = round_keys(_of_team(rounds, team_id), "team_id", "round_date", "round_number")
    return (
        scores.select("round_id", "shooter_id", "total")
        .join(dates, "round_id")
        .join(_named(shooters, "shooter_id", "name"), "shooter_id")
        .select("team_id", "name", "round_date", "round_number", "round_id", "total")
    )


def shooter_trend_points(
    scores: DataFrame, shooters: DataFrame, rounds: DataFrame, team_id: int | None = None
) -> DataFrame:
    """The trend as flat rows, for one team in plotting order."""
    points = trend_points(scores, shooters, rounds, team_id)
    order = ("name", "round_date", "round_number", "round_id", "total")
    return in_order(points, team_id is not None, *order).withColumn("round_date", iso_date("round_date"))


def _paged(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slices: Sequence[Column],
    page_rows: int,
    heavy: DataFrame,
) -> DataFrame:
    """Add ``seq`` (1, 2, ... within ``keys``) and ``page`` (``page_rows`` rows each)."""
    numbered = number_within(rows, keys, order, slices, "seq", heavy)
    return numbered.withColumn("page", F.floor((F.col("seq") - 1) / page_rows).cast("int"))


def _listed(item: Column) -> Column:
    """JSON array of the items in ``seq`` order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("seq"), item.alias("item"))))
    return F.to_json(F.transform(ordered, lambda e: e["item"]), {"ignoreNullFields": "false"})


def shooter_trends(
    scores: DataFrame,
    shooters: DataFrame,
    rounds: DataFrame,
    team_id: int | None = None,
    page_rows: int = PAGE_ROWS,
    heavy_rows: int | None = None,
) -> DataFrame:
    """The trend of every name as a JSON array of {date, total}, oldest first.

    Names, not ids: namesakes within one team's rounds share a series. A series
    longer than ``page_rows`` continues on the next page, so no group of rows is
    ever gathered whole. Points are written once: they are counted before they are numbered.
    """
    points = stage(trend_points(scores, shooters, rounds, team_id), "trend-points")
    keys = ["team_id", "name"]
    order = [F.col(c) for c in ("round_date", "round_number", "round_id", "total")]
    slices = [*order[:2], F.floor(F.col("round_id") / 65_536), *order[2:]]
    paged = _paged(points, keys, order, slices, page_rows, heavy_keys(points, ["name"], heavy_rows))
    point = F.struct(iso_date("round_date").alias("date"), F.col("total"))
    pages = paged.groupBy(*keys, "page").agg(_listed(point).alias("history"))
    return in_order(pages, team_id is not None, "name", "page")


def round_history(
    scores: DataFrame,
    shooters: DataFrame,
    rounds: DataFrame,
    team_id: int | None = None,
    page_rows: int = PAGE_ROWS,
    heavy_rows: int | None = None,
) -> DataFrame:
    """Every round with its score lines as JSON, ``[]`` without scores; for one team newest first.

    Named lines are written once: they are counted before they are numbered.
    """
    rounds = _of_team(rounds, team_id)
    lines = scores
    if team_id is not None:
        lines = lines.join(round_keys(rounds), "round_id", "left_semi")
    # Scores of unknown shooters are not listed.
    lines = lines.join(_named(shooters, "shooter_id", "name"), "shooter_id").join(
        _named(shooters, "subbed_id", "sub_for_name"),
        spread_null_id("sub_for_shooter_id", "round_id", "shooter_id", "total") == F.col("subbed_id"),
        "left",
    )
    lines = stage(lines.drop("subbed_id"), "history-lines")
    order = [F.col(c) for c in ("shooter_id", "sub_for_shooter_id", *STATIONS, "total")]
    slices = [F.floor(F.col("shooter_id") / 65_536), *order[:5]]
    paged = _paged(lines, ["round_id"], order, slices, page_rows, heavy_keys(lines, ["round_id"], heavy_rows))
    entry = F.struct(
        F.col("name"), F.array(*STATIONS).alias("stations"), F.col("total"), F.col("sub_for_name").alias("subFor")
    )
    listed = paged.groupBy("round_id", "page").agg(_listed(entry).alias("shooters"))

    # An inner join spreads the many pages of one round over tasks, a left one would not.
    columns = ["id", "team_id", iso_date("round_date").alias("date"), "yardage", F.col("round_number").alias("roundNumber")]
    paired = rounds.join(listed, rounds["id"] == listed["round_id"]).select(*columns, "page", "shooters")
    bare = rounds.join(lines.select(F.col("round_id").alias("id")), "id", "left_anti").select(
        *columns, F.lit(0).alias("page"), F.lit("[]").alias("shooters")
    )
    history = paired.unionByName(bare)
    return in_order(history, team_id is not None, F.desc("date"), F.desc("roundNumber"), F.desc("id"), "page")


def round_detail(
    scores: DataFrame, shooters: DataFrame, rounds: DataFrame, teams: DataFrame, round_id: int | None = None
) -> DataFrame:
    """Flat score lines of each round (or of one, by name) with team and sub-for name."""
    if round_id is not None:
        scores = scores.filter(F.col("round_id") == round_id)
        rounds = rounds.filter(F.col("id") == round_id)
    team = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    # Names of teams come last: before, they would be shuffled with every score.
    detail = score_lines(scores, shooters, rounds).join(team, "team_id").select(
        "round_id", "team_id", "team_name", iso_date("round_date").alias("round_date"), "round_number", "yardage",
        "shooter_id", "name", *STATIONS, "total", "sub_for_name",
    )
    return in_order(detail, round_id is not None, "name", "shooter_id")


def rounds_overview(scores: DataFrame, rounds: DataFrame, teams: DataFrame) -> DataFrame:
    """Every round with its number of score lines, newest first."""
    counts = scores.groupBy("round_id").agg(F.count(F.lit(1)).alias("n"))
    team = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    return (
        rounds.join(counts, rounds["id"] == counts["round_id"], "left")
        .join(team, "team_id")
        .select(
            "id", "team_id", "team_name", iso_date("round_date").alias("round_date"), "round_number", "yardage",
            F.coalesce("n", F.lit(0)).alias("shooter_count"),
        )
        .orderBy(F.desc("round_date"), F.desc("round_number"), F.desc("id"))
    )


def shooters_overview(scores: DataFrame, shooters: DataFrame, teams: DataFrame) -> DataFrame:
    """Every shooter with the team they are on now and their number of scores."""
    counts = scores.groupBy("shooter_id").agg(F.count(F.lit(1)).alias("n"))
    team = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    return (
        shooters.join(counts, shooters["id"] == counts["shooter_id"], "left")
        .join(team, "team_id")
        .select("id", "name", "team_id", "team_name", F.coalesce("n", F.lit(0)).alias("rounds"))
        .orderBy("team_name", "name", "id")
    )


def shooter_totals(scores: DataFrame, shooters: DataFrame, teams: DataFrame) -> DataFrame:
    """Points and score count per shooter, under the team they are on now."""
    sums = scores.groupBy("shooter_id").agg(
        F.sum("total").alias("total_points"), F.count(F.lit(1)).alias("rounds")
    )
    team = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    member = shooters.select(F.col("id").alias("shooter_id"), "name", "team_id")
    return sums.join(member, "shooter_id").join(team, "team_id").withColumnRenamed("shooter_id", "id")


def team_totals(scores: DataFrame, rounds: DataFrame, teams: DataFrame) -> DataFrame:
    """Points and rounds with scores per team the rounds belong to.

    Scores shrink to one row per round first, which also makes the round count a
    plain count instead of a distinct one.
    """
    per_round = scores.groupBy("round_id").agg(F.sum("total").alias("points"))
    team = teams.select(F.col("id").alias("team_id"), "name")
    return (
        per_round.join(round_keys(rounds, "team_id"), "round_id")
        .groupBy("team_id")
        .agg(F.sum("points").alias("total_points"), F.count(F.lit(1)).alias("rounds"))
        .join(team, "team_id")
    )


def with_logo(top: DataFrame, logos: DataFrame, name: str) -> DataFrame:
    """Look up the logo of a handful of rows that carry ``team_id``.

    ``top`` is the output of a top-k of at most TOP_K rows, so it is the small
    side; the wide logo table is scanned in place and never shuffled.
    """
    hits = logos.join(F.broadcast(top.select("team_id").distinct()), "team_id", "left_semi")
    return top.join(
        F.broadcast(hits.select("team_id", F.col("logo_data").alias(name))), "team_id", "left"
    )


def top_by_points(totals: DataFrame, id_column: str, k: int) -> DataFrame:
    return totals.orderBy(F.desc("total_points"), id_column).limit(k)


def site_top_individuals(
    scores: DataFrame, shooters: DataFrame, teams: DataFrame, logos: DataFrame, k: int = TOP_K
) -> DataFrame:
    """The shooters with the most points on the whole site."""
    top = top_by_points(shooter_totals(scores, shooters, teams), "id", k)
    return (
        with_logo(top, logos, "team_logo")
        .select("id", "name", "team_id", "team_name", "team_logo", "total_points", "rounds")
        .orderBy(F.desc("total_points"), "id")
    )


def site_top_teams(
    scores: DataFrame, rounds: DataFrame, teams: DataFrame, logos: DataFrame, k: int = TOP_K
) -> DataFrame:
    """The teams with the most points on the whole site."""
    top = top_by_points(team_totals(scores, rounds, teams), "team_id", k)
    return (
        with_logo(top, logos, "logo")
        .select(F.col("team_id").alias("id"), "name", "logo", "total_points", "rounds")
        .orderBy(F.desc("total_points"), "id")
    )


def site_trends(scores: DataFrame, rounds: DataFrame) -> DataFrame:
    """Average score of each day across all teams."""
    per_round = scores.groupBy("round_id").agg(F.sum("total").alias("points"), F.count(F.lit(1)).alias("n"))
    return (
        per_round.join(round_keys(rounds, "round_date"), "round_id")
        .groupBy("round_date")
        .agg(exact_avg(F.sum("points"), F.sum("n"), 1).alias("avg"))
        .orderBy("round_date")
        .select(iso_date("round_date").alias("date"), "avg")
    )
