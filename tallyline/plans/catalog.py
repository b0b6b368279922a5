"""Every query by name, bound to the tables of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.exprs import iso_date
from tallyline.operators import derived, directory, ingest, maintain, membership, reads, removal
from tallyline.operators.reads import STATIONS
from tallyline.session import prepare, scratch, stage
from tallyline.sources import layout, sheets, tables
from tallyline.sources.fixtures import ClubData
from tallyline.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Callable[[ClubData], DataFrame]] = {}


def query(build: Callable[[ClubData], DataFrame]) -> Callable[[ClubData], DataFrame]:
    CATALOG[build.__name__] = build
    return build


def bound(build: Callable[[ClubData], DataFrame]) -> Query:
    return lambda spark, folder: build(ClubData(prepare(spark), folder))


def queries() -> dict[str, Query]:
    return {name: bound(build) for name, build in CATALOG.items()}


# --- leaderboards, trends, histories -------------------------------------------


@query
def team_leaderboard(d: ClubData) -> DataFrame:
    return reads.team_leaderboard(d.scores, d.shooters, d.rounds)


@query
def shooter_trends(d: ClubData) -> DataFrame:
    return reads.shooter_trends(d.scores, d.shooters, d.rounds)


@query
def shooter_trend_points(d: ClubData) -> DataFrame:
    return reads.shooter_trend_points(d.scores, d.shooters, d.rounds)


@query
def site_top_individuals(d: ClubData) -> DataFrame:
    return reads.site_top_individuals(d.scores, d.shooters, d.teams, d.team_logos)


@query
def site_top_teams(d: ClubData) -> DataFrame:
    return reads.site_top_teams(d.scores, d.rounds, d.teams, d.team_logos)


@query
def site_trends(d: ClubData) -> DataFrame:
    return reads.site_trends(d.scores, d.rounds)


@query
def round_history(d: ClubData) -> DataFrame:
    return reads.round_history(d.scores, d.shooters, d.rounds)


@query
def round_detail(d: ClubData) -> DataFrame:
    return reads.round_detail(d.scores, d.shooters, d.rounds, d.teams)


@query
def rounds_overview(d: ClubData) -> DataFrame:
    return reads.rounds_overview(d.scores, d.rounds, d.teams)


@query
def shooters_overview(d: ClubData) -> DataFrame:
    return reads.shooters_overview(d.scores, d.shooters, d.teams)


# --- the stored layout ----------------------------------------------------------------


def stored_layout(d: ClubData, by: str) -> layout.Layout:
    """Rounds and scores in the stored layout, written once per session and data folder."""
    return d.once(f"layout-{by}", lambda path: _laid_out(d, path, by))


def _laid_out(d: ClubData, path: str, by: str) -> layout.Layout:
    own = layout.Layout(d.spark, path, f"club_{uuid.uuid4().hex}", by, layout.buckets_for(d.scores)).attach()
    own.write(d.rounds, d.scores)
    return own


@query
def stored_leaderboard(d: ClubData) -> DataFrame:
    """The leaderboard from the layout by month: scores are not shuffled."""
    own = stored_layout(d, layout.MONTH)
    return reads.team_leaderboard(own.read("scores"), d.shooters, own.read("rounds"))


@query
def month_trends(d: ClubData) -> DataFrame:
    """Daily averages of March 1995, from one partition."""
    own = stored_layout(d, layout.MONTH)
    return reads.site_trends(own.read("scores", month=199503), own.read("rounds", month=199503))


@query
def stored_team_leaderboard(d: ClubData) -> DataFrame:
    """The leaderboard of team 3 from the layout by team, from one partition."""
    own = stored_layout(d, layout.TEAM)
    return reads.team_leaderboard(own.read("scores", team_id=3), d.shooters, own.read("rounds", team_id=3), team_id=3)


@query
def replaced_year(d: ClubData) -> DataFrame:
    """Rounds and their number of scores after 1995 was written anew without its odd rounds and all at 27 yards."""
    own = _laid_out(d, scratch(d.spark, "layout"), layout.YEAR)
    even = own.read("rounds", year=1995).filter("id % 2 = 0")
    scores = own.read("scores", year=1995).join(even.select(F.col("id").alias("round_id")), "round_id", "left_semi")
    # The new content comes from the partition it replaces, so it is written down first.
    own.write(stage(even.withColumn("yardage", F.lit(27).cast("smallint")), "year"), stage(scores, "year-scores"))
    counts = own.read("scores").groupBy("round_id").agg(F.count(F.lit(1)).alias("n_scores"))
    return own.read("rounds").withColumn("round_date", iso_date("round_date")).join(
        counts, F.col("id") == F.col("round_id"), "left"
    ).drop("round_id").na.fill(0, ["n_scores"])


# --- teams, leagues, members -----------------------------------------------------


@query
def team_directory(d: ClubData) -> DataFrame:
    return directory.team_directory(d.teams, d.leagues, d.team_logos)


@query
def user_directory(d: ClubData) -> DataFrame:
    return directory.user_directory(d.users, d.teams)


@query
def league_directory(d: ClubData) -> DataFrame:
    return directory.league_directory(d.leagues)


@query
def squad_leaders(d: ClubData) -> DataFrame:
    return directory.squad_leaders(d.users)


@query
def pending_members(d: ClubData) -> DataFrame:
    return directory.pending_members(d.users)


@query
def pending_notifications(d: ClubData) -> DataFrame:
    return directory.pending_notifications(d.users, d.teams)


@query
def notification_recipients(d: ClubData) -> DataFrame:
    return directory.notification_recipients(d.users)


@query
def member_access(d: ClubData) -> DataFrame:
    return directory.member_access(d.users)


@query
def visible_rounds(d: ClubData) -> DataFrame:
    return directory.visible_rounds(d.rounds, d.users)


@query
def team_member_counts(d: ClubData) -> DataFrame:
    return directory.team_member_counts(d.users)


# --- derived statistics -----------------------------------------------------------


@query
def team_summary(d: ClubData) -> DataFrame:
    return derived.team_summary(d.scores, d.rounds, d.teams)


@query
def team_trends_top5(d: ClubData) -> DataFrame:
    return derived.team_trends_top5(d.scores, d.shooters, d.rounds)


@query
def shooter_drilldown(d: ClubData) -> DataFrame:
    return derived.shooter_drilldown(d.scores, d.shooters)


@query
def shooter_history(d: ClubData) -> DataFrame:
    return derived.shooter_history(d.scores, d.shooters, d.rounds)


@query
def station_accuracy(d: ClubData) -> DataFrame:
    return derived.station_accuracy(d.scores, d.rounds)


@query
def leader_callouts(d: ClubData) -> DataFrame:
    return derived.leader_callouts(d.scores, d.shooters, d.rounds, d.teams, d.team_logos)


@query
def next_round_number(d: ClubData) -> DataFrame:
    return derived.next_round_number(d.rounds)


@query
def badged_shooters(d: ClubData) -> DataFrame:
    return derived.badged_shooters(d.shooters, d.users)


@query
def leagues_for_member(d: ClubData) -> DataFrame:
    return derived.leagues_for_member(d.leagues, d.teams, d.users)


@query
def league_lists(d: ClubData) -> DataFrame:
    return derived.league_lists(d.leagues, d.teams)


@query
def history_labels(d: ClubData) -> DataFrame:
    return derived.history_labels(d.scores, d.shooters, d.rounds)


# --- ingest -------------------------------------------------------------------------


def _lines(d: ClubData) -> DataFrame:
    return sheets.flat_line_rows(d.submission_lines)


def _accepted(d: ClubData) -> DataFrame:
    """Accepted lines, for plans that read them several times."""
    judged = stage(ingest.judged_lines(_lines(d)), "judged-lines")
    return ingest.accepted_lines(d.submission_headers, judged)


def _stored_ids_only(roster: DataFrame) -> DataFrame:
    """The roster with new ids hidden: they depend on the engine that hands them out."""
    return roster.withColumn("id", F.when(~F.col("is_new"), F.col("id")))


@query
def explode_scoresheets(d: ClubData) -> DataFrame:
    return sheets.sheet_line_rows(sheets.parse_sheets(d.documents))


@query
def extract_json(d: ClubData) -> DataFrame:
    found = ingest.extract_json(d.raw_extractions)
    return found.select("event_id", "accepted", F.to_json("parsed").alias("parsed"))


@query
def normalised_lines(d: ClubData) -> DataFrame:
    return ingest.normalised_lines(_lines(d))


@query
def sheet_headers(d: ClubData) -> DataFrame:
    return ingest.sheet_headers(d.submission_headers).withColumn("round_date", iso_date("round_date"))


@query
def rejected_submissions(d: ClubData) -> DataFrame:
    """Every 53rd sheet names a team that is not stored."""
    team = F.when(F.col("submission_id") % 53 == 0, 999).otherwise(F.col("team_id"))
    headers = ingest.with_known_teams(d.submission_headers.withColumn("team_id", team), d.teams)
    return ingest.rejected_submissions(headers, ingest.judged_lines(_lines(d)))


@query
def submitted_headers(d: ClubData) -> DataFrame:
    """Sheets sent by accounts: most name no team, their own or another one; some come from nobody or an unknown account."""
    headers = ingest.with_submitters(d.sent_headers, d.users)
    return ingest.sheet_headers(headers).withColumn("round_date", iso_date("round_date"))


@query
def substitutions(d: ClubData) -> DataFrame:
    return ingest.substitutions(_lines(d))


@query
def roster_after_ingest(d: ClubData) -> DataFrame:
    return _stored_ids_only(ingest.roster_upsert(_accepted(d), d.shooters))


@query
def facts_after_ingest(d: ClubData) -> DataFrame:
    lines = _accepted(d)
    added = stage(ingest.roster_additions(lines, d.shooters), "new-names")
    roster = ingest.extended_roster(d.shooters, added)
    return ingest.facts(lines, _stored_ids_only(roster)).withColumn("round_date", iso_date("round_date"))


@query
def split_rounds(d: ClubData) -> DataFrame:
    return ingest.split_rounds(d.submission_headers, ingest.judged_lines(_lines(d)))


def _edited(d: ClubData) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every 13th sheet edits its round: some move it to the next team, some name no team or one that is not stored."""
    edited = F.col("submission_id") % 13 == 0
    number = F.col("submission_id")
    team = (
        F.when(number % 39 == 0, F.lit(None)).when(number % 26 == 0, 0).when(number % 65 == 0, 999)
        .otherwise(F.col("team_id") % 25 + 1)
    )
    headers = d.submission_headers.filter(edited).withColumn("team_id", team.cast("int"))
    return ingest.scores_after_edit(d.scores, d.shooters, d.rounds, headers, _lines(d).filter(edited), d.teams)


@query
def scores_after_edit(d: ClubData) -> DataFrame:
    scores, roster, rounds, _ = _edited(d)
    # New ids depend on the engine; the round a score came from and its number do not.
    natural = ("source_id", "team_id", "round_number", "yardage")
    return reads.score_lines(scores, roster, rounds, round_columns=natural).select(
        *natural, "name", "sub_for_name", *STATIONS, "total"
    )


@query
def rounds_after_edit(d: ClubData) -> DataFrame:
    return _edited(d)[2].select("source_id", "team_id", iso_date("round_date").alias("round_date"), "round_number", "yardage")


@query
def edit_report(d: ClubData) -> DataFrame:
    return _edited(d)[3]


# --- maintenance ---------------------------------------------------------------------


def _user_patch(d: ClubData) -> tuple[DataFrame, DataFrame]:
    """Every fourth account: some lose their team, move, or ask for a team that is not stored; flags of NULL count for nothing."""
    number = F.col("id")
    yes = F.lit(True)
    team = F.when(number % 24 == 0, 999).when(number % 20 == 0, 3).when(number % 16 == 0, 0)
    patch = d.users.filter(number % 4 == 0).select(
        "id",
        F.lit(None).cast("boolean").alias("is_admin"), yes.alias("is_admin_set"),
        F.when(number % 12 != 0, True).alias("is_squad_leader"), yes.alias("is_squad_leader_set"),
        F.lit(False).alias("team_approved"), (number % 28 == 0).alias("team_approved_set"),
        team.cast("int").alias("team_id"), (number % 8 == 0).alias("team_id_set"),
    )
    return maintain.patch_users(d.users, patch, d.teams)


@query
def patched_users(d: ClubData) -> DataFrame:
    return _user_patch(d)[0].drop("created_at")


@query
def user_patch_report(d: ClubData) -> DataFrame:
    return _user_patch(d)[1]


def _team_patch(d: ClubData) -> tuple[DataFrame, DataFrame]:
    """Odd teams are renamed, every third also loses its league; team 3 asks for a taken name, team 7 for an unknown league."""
    odd = F.col("id") % 2 == 1
    name = F.when(F.col("id") == 3, "NATION_5").otherwise(F.concat(F.lit(" New "), "name", F.lit(" ")))
    league = F.when(F.col("id") == 7, 999).when(F.col("id") == 9, 0).cast("int")
    patch = d.teams.filter(odd).select(
        "id", name.alias("name"), league.alias("league_id"),
        ((F.col("id") % 3 == 0) | (F.col("id") == 7)).alias("league_id_set"),
    )
    return maintain.patch_teams(d.teams, patch, d.leagues)


@query
def patched_teams(d: ClubData) -> DataFrame:
    return _team_patch(d)[0]


@query
def team_patch_report(d: ClubData) -> DataFrame:
    return _team_patch(d)[1].select("id", "outcome")


def _shooter_patch(d: ClubData) -> tuple[DataFrame, DataFrame]:
    """Every fifth shooter is renamed (a blank name keeps the old one), every tenth also moves, some to no stored team."""
    name = F.when(F.col("id") % 15 == 0, "  ").otherwise(F.concat(F.lit(" New "), "name"))
    team = F.when(F.col("id") % 70 == 0, 999).when(F.col("id") % 10 == 0, F.col("team_id") % 25 + 1)
    patch = d.shooters.filter("id % 5 = 0").select("id", name.alias("name"), team.cast("int").alias("team_id"))
    return maintain.patch_shooters(d.shooters, patch, d.teams)


@query
def patched_shooters(d: ClubData) -> DataFrame:
    return _shooter_patch(d)[0]


@query
def shooter_patch_report(d: ClubData) -> DataFrame:
    return _shooter_patch(d)[1]


def _logo_patch(d: ClubData) -> tuple[DataFrame, DataFrame]:
    """Every member asks for a logo, by turns for their own and the next team; some send no image, some name no stored team."""
    image = F.when(F.col("id") % 4 == 1, "logo.png").when(F.col("id") % 4 != 2, F.concat(F.lit("data:image/png;"), "email"))
    wanted = F.when(F.col("id") % 100 == 0, 999).otherwise((F.col("team_id") - 1 + F.col("id") % 2) % 25 + 1).cast("int")
    requests = d.users.filter("team_id IS NOT NULL").select(
        F.col("id").alias("seq"), wanted.alias("team_id"), image.alias("logo_data"),
        "is_admin", "is_squad_leader", F.col("team_id").alias("own_team_id"),
    )
    return maintain.patch_logos(d.team_logos, requests, d.teams)


@query
def patched_logos(d: ClubData) -> DataFrame:
    return _logo_patch(d)[0]


@query
def logo_report(d: ClubData) -> DataFrame:
    return _logo_patch(d)[1]


@query
def replaced_profiles(d: ClubData) -> DataFrame:
    """Even accounts send a phone number, every fourth a name; what is blank or missing is cleared."""
    values = d.users.filter("id % 2 = 0").select(
        "id",
        F.when(F.col("id") % 4 == 0, F.concat(F.lit(" "), "email")).otherwise(" ").alias("name"),
        F.concat(F.lit(" 555-"), "id").alias("phone"),
    )
    return maintain.replace_profiles(d.users, values).select("id", "name", "phone", "address")


@query
def replaced_leagues(d: ClubData) -> DataFrame:
    hall = F.when(F.col("id") % 2 == 0, "  ").otherwise(" Hall ")
    return maintain.replace_leagues(d.leagues, d.leagues.select("id", hall.alias("location")))


def _inserted_shooters(d: ClubData) -> tuple[DataFrame, DataFrame]:
    """Every name on the sheets is asked for; some for a team that is not stored, some for none."""
    number = F.col("submission_id")
    team = F.when(number % 31 == 0, 999).when(number % 37 == 0, 0).otherwise(F.col("team_id"))
    headers = d.submission_headers.select("submission_id", team.alias("team_id"))
    requests = d.submission_lines.select("submission_id", "pos", "raw_name").join(headers, "submission_id")
    return maintain.insert_shooters(requests, d.shooters, d.teams)


@query
def keyed_insert_report(d: ClubData) -> DataFrame:
    return _inserted_shooters(d)[1]


def _without_new_ids(after: DataFrame, before: DataFrame) -> DataFrame:
    """``after`` with ids that ``before`` lacks hidden: they depend on the engine that hands them out."""
    known = before.select(F.col("id").alias("known_id"))
    joined = after.join(known, after["id"] == known["known_id"], "left")
    return joined.withColumn("id", F.col("known_id")).drop("known_id")


@query
def shooters_after_insert(d: ClubData) -> DataFrame:
    return _without_new_ids(_inserted_shooters(d)[0], d.shooters)


def _inserted_leagues(d: ClubData) -> tuple[DataFrame, DataFrame]:
    """Every team asks for a league: of a stored name, of one several ask for, or without a name."""
    name = F.when(F.col("id") % 5 == 0, "  ").when(F.col("id") % 5 == 1, "ASIA").otherwise(
        F.concat(F.lit(" League "), (F.col("id") % 7).cast("string"))
    )
    requests = d.teams.select(F.col("id").alias("seq"), name.alias("name"), F.concat(F.lit(" "), "name").alias("location"))
    return maintain.insert_leagues(requests, d.leagues)


@query
def leagues_after_insert(d: ClubData) -> DataFrame:
    return _without_new_ids(_inserted_leagues(d)[0], d.leagues).select("id", "name", "location", "contact_name")


@query
def league_insert_report(d: ClubData) -> DataFrame:
    return _inserted_leagues(d)[1]


def _intake(d: ClubData) -> tuple[DataFrame, DataFrame]:
    return maintain.users_after_intake(maintain.account_intake(d.applicants, d.users, d.teams), d.users, d.teams)


@query
def teams_after_intake(d: ClubData) -> DataFrame:
    """Teams with those founded by new accounts added; their ids are hidden."""
    return _without_new_ids(_intake(d)[1], d.teams)


@query
def users_after_intake(d: ClubData) -> DataFrame:
    """Accounts by email, with the name of their team."""
    users, teams = _intake(d)
    named = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team"))
    return _without_new_ids(users, d.users).join(named, "team_id", "left").select(
        "id", "email", "name", "is_admin", "is_squad_leader", "team_approved", "team"
    )


@query
def after_delete_users(d: ClubData) -> DataFrame:
    """Every ninth account is to go; account 18 asks for it and so stays."""
    wanted = d.users.filter("id % 9 = 0").select("id", F.lit(18).alias("requested_by"))
    return maintain.without_users(d.users, wanted).select("id", "email")


@query
def after_delete_rounds(d: ClubData) -> DataFrame:
    return maintain.without_rounds(d.scores, d.rounds.filter("id % 11 = 0").select("id"))


@query
def after_delete_shooters(d: ClubData) -> DataFrame:
    return maintain.without_shooters(d.scores, d.shooters.filter("id % 7 = 0").select("id"))


def _unwanted_teams(d: ClubData) -> tuple[DataFrame, DataFrame]:
    """Every fifth team; every other one of these has no members."""
    return d.teams.filter("id % 5 = 0").select("id"), d.users


def _after_delete_teams(d: ClubData) -> dict[str, DataFrame]:
    wanted, members = _unwanted_teams(d)
    return maintain.delete_teams(wanted, d.teams, d.shooters, d.rounds, d.scores, members)


@query
def after_delete_teams(d: ClubData) -> DataFrame:
    return _after_delete_teams(d)["scores"]


@query
def teams_after_delete(d: ClubData) -> DataFrame:
    return _after_delete_teams(d)["teams"]


@query
def shooters_after_delete(d: ClubData) -> DataFrame:
    return _after_delete_teams(d)["shooters"]


@query
def rounds_after_delete(d: ClubData) -> DataFrame:
    return _after_delete_teams(d)["rounds"].withColumn("round_date", iso_date("round_date"))


@query
def team_delete_report(d: ClubData) -> DataFrame:
    wanted, members = _unwanted_teams(d)
    return maintain.team_delete_report(wanted, d.teams, members)


def _delete_tables(d: ClubData) -> dict[str, DataFrame]:
    return {"rounds": d.rounds, "shooters": d.shooters, "teams": d.teams, "leagues": d.leagues, "users": d.users, "scores": d.scores}


@query
def delete_report(d: ClubData) -> DataFrame:
    """Every event asks for a delete, a third of them in the name of an admin."""
    return removal.delete_report(d.delete_requests, _delete_tables(d))


@query
def scores_after_requests(d: ClubData) -> DataFrame:
    tables = _delete_tables(d)
    return removal.after_deletes(stage(removal.delete_report(d.delete_requests, tables), "delete-report"), tables)["scores"]


@query
def after_delete_leagues(d: ClubData) -> DataFrame:
    return maintain.without_leagues(d.teams, d.leagues.filter("id = 2").select("id"))


@query
def account_intake(d: ClubData) -> DataFrame:
    return maintain.account_intake(d.applicants, d.users, d.teams)


@query
def identity_match(d: ClubData) -> DataFrame:
    return maintain.identity_match(d.identities, d.users)


@query
def users_after_sign_in(d: ClubData) -> DataFrame:
    users = maintain.users_after_sign_in(maintain.identity_match(d.identities, d.users), d.identities, d.users)
    return _without_new_ids(users, d.users).select(
        "id", "email", "google_id", "name", "is_admin", "is_squad_leader", "team_approved", "team_id"
    )


def _after_requests(d: ClubData) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables that one batch of requests gives, written once per session and data folder."""

    def written(path: str) -> str:
        found = membership.apply_requests(d.users, d.membership_requests, d.teams)
        for name, rows in zip(_REQUEST_TABLES, found):
            rows.write.parquet(f"{path}/{name}")
        return path

    path = d.once("membership", written)
    return tuple(d.spark.read.parquet(f"{path}/{name}") for name in _REQUEST_TABLES)


_REQUEST_TABLES = ("users", "outcomes", "teams")


@query
def membership_after_requests(d: ClubData) -> DataFrame:
    """Accounts with the name of their team: ids of teams founded meanwhile depend on the engine."""
    users, _, teams = _after_requests(d)
    named = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team"))
    return users.join(named, "team_id", "left").select("id", "team", "team_approved", "is_squad_leader")


@query
def membership_request_outcomes(d: ClubData) -> DataFrame:
    return _after_requests(d)[1]


@query
def teams_after_requests(d: ClubData) -> DataFrame:
    """Teams with those founded by requests added; their ids are hidden."""
    return _without_new_ids(_after_requests(d)[2], d.teams)


@query
def backfilled_rounds(d: ClubData) -> DataFrame:
    gaps = d.rounds.withColumn("team_id", F.when(F.col("id") % 3 != 0, F.col("team_id")))
    return maintain.backfill_team(gaps, maintain.with_default_team(d.teams)).withColumn(
        "round_date", iso_date("round_date")
    )


def _generations(d: ClubData, table: str, *ages: DataFrame) -> DataFrame:
    """A table from one folder of files that were written with other columns each time."""
    folder = scratch(d.spark, f"{table}-files")
    for rows in ages:
        rows.write.mode("append").parquet(folder)
    return tables.read_generations(d.spark, folder, table, lambda old: maintain.added_columns(old, table))


@query
def upgraded_rounds(d: ClubData) -> DataFrame:
    """Rounds before 1995 come from files that lack the yardage and the round number."""
    old = F.col("round_date") < "1995-01-01"
    found = _generations(d, "rounds", d.rounds.filter(old).drop("yardage", "round_number"), d.rounds.filter(~old))
    return found.withColumn("round_date", iso_date("round_date"))


@query
def upgraded_scores(d: ClubData) -> DataFrame:
    """Scores of even rounds come from files that know no substitutes."""
    old = F.col("round_id") % 2 == 0
    return _generations(d, "scores", d.scores.filter(old).drop("sub_for_shooter_id"), d.scores.filter(~old))


@query
def upgraded_users(d: ClubData) -> DataFrame:
    """Accounts by thirds: from before names, from before outside ids and squad leaders, and of today."""
    first, second, third = (d.users.filter(F.col("id") % 3 == k) for k in range(3))
    newest = ("google_id", "is_squad_leader", "team_approved")
    return _generations(
        d, "users", first.drop("name", "phone", "address", *newest), second.drop(*newest), third
    ).drop("created_at")


@query
def constraint_violations(d: ClubData) -> DataFrame:
    tables = {
        "leagues": d.leagues, "teams": d.teams, "users": d.users,
        "shooters": d.shooters, "rounds": d.rounds, "scores": d.scores,
    }
    return maintain.constraint_violations(tables, d.team_logos)


# --- streams -------------------------------------------------------------------------


@query
def stream_ingest(d: ClubData) -> DataFrame:
    return jobs.ingest_documents(d.spark, d.documents, d.shooters, d.teams)


@query
def stream_leaderboard(d: ClubData) -> DataFrame:
    return jobs.stream_totals(d.spark, _accepted(d))
