"""Teams, leagues, members, approvals and who may see what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.exprs import iso_date

def _stamp(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def team_directory(teams: DataFrame, leagues: DataFrame, logos: DataFrame) -> DataFrame:
    """Every team with its logo and, if it has one, its league."""
    league = leagues.select(F.col("id").alias("league_id"), F.col("name").alias("league_name"))
    return (
        teams.join(league, "league_id", "left")
        .join(logos.withColumnRenamed("team_id", "id"), "id", "left")
        .select("id", "name", "logo_data", "league_id", "league_name")
        .orderBy("name", "id")
    )


def user_directory(users: DataFrame, teams: DataFrame) -> DataFrame:
    """Every account with its team's name, oldest first."""
    team = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    return (
        users.join(team, "team_id", "left")
        .orderBy("created_at", "id")
        .select(
            "id", "email", "name", "phone", "is_admin", "is_squad_leader", "team_approved", "team_id", "team_name",
            _stamp("created_at").alias("created_at"),
        )
    )


def league_directory(leagues: DataFrame) -> DataFrame:
    return leagues.orderBy("name", "id")


def squad_leaders(users: DataFrame) -> DataFrame:
    return users.filter(F.col("is_squad_leader") & F.col("name").isNotNull()).select("name", "team_id")


def _pending(users: DataFrame) -> DataFrame:
    return users.filter(~F.col("team_approved") & F.col("team_id").isNotNull())


def pending_members(users: DataFrame, team_id: int | None = None) -> DataFrame:
    """Accounts that wait for approval, per team, longest wait first."""
    pending = _pending(users)
    if team_id is not None:
        pending = pending.filter(F.col("team_id") == team_id)
    return pending.orderBy("team_id", "created_at", "id").select(
        "team_id", "id", "email", "name", "phone", _stamp("created_at").alias("created_at")
    )


def _approvers(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members who may approve (tier 1 leaders, tier 2 admins), and each team's best tier."""
    tier = F.when(F.col("is_squad_leader"), 1).when(F.col("is_admin"), 2)
    able = users.filter(F.col("team_id").isNotNull()).select("team_id", "email", tier.alias("tier"))
    able = able.filter(F.col("tier").isNotNull())
    sizes = able.groupBy("team_id").agg(
        F.min("tier").alias("tier"),
        F.count_if(F.col("tier") == 1).alias("leaders"),
        F.count(F.lit(1)).alias("everyone"),
    )
    best = sizes.select(
        "team_id", "tier",
        F.when(F.col("tier") == 1, F.col("leaders")).otherwise(F.col("everyone")).alias("recipients"),
    )
    return able, best


def notification_recipients(users: DataFrame) -> DataFrame:
    """Whom to write to about requests for a team: its leaders, else its admins."""
    able, best = _approvers(users)
    return able.join(best.select("team_id", "tier"), ["team_id", "tier"], "left_semi").select(
        "team_id", "tier", "email"
    )


def pending_notifications(users: DataFrame, teams: DataFrame) -> DataFrame:
    """One message per pending member whose team has anyone to approve them.

    The addresses are in ``notification_recipients`` under the same team, so a
    large team does not turn into one row per member and recipient.
    """
    _, best = _approvers(users)
    who = F.when(
        F.coalesce(F.col("name"), F.lit("")) != "", F.concat("name", F.lit(" ("), "email", F.lit(")"))
    ).otherwise(F.col("email"))
    team = teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    return (
        _pending(users)
        .select("team_id", F.col("id").alias("user_id"), who.alias("who"))
        .join(best, "team_id")
        .join(team, "team_id", "left")
        .withColumn("team_name", F.coalesce("team_name", F.lit("your team")))
        .withColumn("subject", F.concat("who", F.lit(" wants to join "), "team_name"))
        .select("team_id", "team_name", "user_id", "who", "subject", "tier", "recipients")
    )


def member_access(users: DataFrame) -> DataFrame:
    """Per account: the team whose rounds and statistics it may read (NULL: site-wide views only)."""
    sees = F.when(F.col("team_approved"), F.col("team_id"))
    status = (
        F.when(F.col("team_id").isNull(), "no team")
        .when(~F.col("team_approved"), "pending")
        .otherwise("member")
    )
    return users.select(F.col("id").alias("user_id"), sees.alias("visible_team_id"), status.alias("status"))


def visible_rounds(rounds: DataFrame, users: DataFrame) -> DataFrame:
    """Rounds at least one account may read, with the number of such accounts.

    For a chosen set of accounts pass only those as ``users``.
    """
    viewers = (
        member_access(users)
        .filter(F.col("visible_team_id").isNotNull())
        .groupBy(F.col("visible_team_id").alias("team_id"))
        .agg(F.count(F.lit(1)).alias("viewers"))
    )
    return rounds.join(viewers, "team_id").select(
        "id", "team_id", iso_date("round_date").alias("round_date"), "round_number", "yardage", "viewers"
    )


def team_member_counts(users: DataFrame) -> DataFrame:
    """Accounts per team, accounts without one, and all accounts."""
    per_team = users.groupBy("team_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per_team.rollup("team_id").agg(F.sum("n").alias("members"), F.grouping("team_id").alias("all"))
    scope = F.when(F.col("all") == 1, "site").when(F.col("team_id").isNull(), "no team").otherwise("team")
    return totals.select(scope.alias("scope"), "team_id", "members")
