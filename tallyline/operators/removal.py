"""Requested deletes: who may remove what, in which order, and the tables that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.exprs import spread_null_id
from tallyline.operators import maintain
from tallyline.session import stage

#: What can be asked for, by the table it is in.
KINDS = {"round": "rounds", "shooter": "shooters", "team": "teams", "league": "leagues", "user": "users"}


def _targets(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, team_id) of everything that is stored."""
    team = {"round": F.col("team_id"), "shooter": F.col("team_id"), "team": F.col("id")}
    parts = [
        tables[table].select(
            F.lit(kind).alias("kind"), F.col("id").cast("bigint").alias("id"),
            team.get(kind, F.lit(None)).cast("int").alias("team_id"),
        )
        for kind, table in KINDS.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _judged(requests: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Requests with their target's team and ``fault``, what is wrong with them whatever came before."""
    asked = requests.select("seq", "kind", F.col("id").cast("bigint").alias("id"), F.col("requested_by").cast("bigint").alias("requested_by"))
    by = tables["users"].select(F.col("id").cast("bigint").alias("_by"), "is_admin", F.col("team_id").alias("_own_team"))
    there = _targets(tables).withColumn("_there", F.lit(True))
    placed = asked.join(by, spread_null_id("requested_by", "seq") == F.col("_by"), "left").join(there, ["kind", "id"], "left")
    stored = F.col("_there").isNotNull()
    own = (F.col("kind") == "round") & (F.col("team_id") == F.col("_own_team"))
    may = F.coalesce(F.col("is_admin"), F.lit(False)) | F.coalesce(own, F.lit(False))
    fault = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown_kind")
        .when((F.col("kind") == "round") & ~stored, "not_found")
        .when(~may, "forbidden")
        .when(~stored, "not_found")
        .when((F.col("kind") == "user") & (F.col("id") == F.col("requested_by")), "own_account")
    )
    return placed.select("seq", "kind", "id", "requested_by", "team_id", fault.alias("fault"))


def delete_report(requests: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(seq, kind, id, requested_by, outcome) of requests (seq, kind, id, requested_by), applied in order of ``seq`` (unique).

    ``kind`` is round, shooter, team, league or user. Admins may remove anything but
    their own account; members only rounds of their own team; both as the accounts
    stand before the batch. A team goes when the last of its members is gone, and its
    rounds and shooters go with it. Outcomes: deleted, forbidden, not_found (also once
    it is gone), has_members, own_account, unknown_kind.
    """
    judged = stage(_judged(requests, tables), "delete-requests")
    sound = judged.filter("fault IS NULL")
    first = sound.filter("kind <> 'team'").groupBy("kind", "id").agg(F.min("seq").alias("first"))
    left_at = first.filter("kind = 'user'").select("id", F.col("first").alias("left_at"))
    # Until when a team has members; an account that stays holds it for good.
    members = tables["users"].filter("team_id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "team_id").join(left_at, "id", "left")
    held = members.groupBy("team_id").agg(
        F.max("left_at").alias("until"), F.count_if(F.col("left_at").isNull()).alias("staying")
    )
    attempts = sound.filter("kind = 'team'").select("team_id", "seq").join(held, "team_id", "left")
    free = F.col("until").isNull() | (F.col("seq") > F.col("until"))
    closed = attempts.filter((F.coalesce("staying", F.lit(0)) == 0) & free).groupBy("team_id").agg(F.min("seq").alias("closed"))
    known = (
        judged.join(first, ["kind", "id"], "left")
        .join(closed.withColumnRenamed("team_id", "_team"), spread_null_id("team_id", "seq") == F.col("_team"), "left")
    )
    of_team = (
        F.when(F.col("closed").isNull() | (F.col("seq") < F.col("closed")), "has_members")
        .when(F.col("seq") == F.col("closed"), "deleted").otherwise("not_found")
    )
    gone = (F.col("first") < F.col("seq")) | F.coalesce(F.col("closed") < F.col("seq"), F.lit(False))
    outcome = F.coalesce("fault", F.when(F.col("kind") == "team", of_team).when(gone, "not_found").otherwise("deleted"))
    return known.select("seq", "kind", "id", "requested_by", outcome.alias("outcome"))


def after_deletes(report: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after a ``delete_report``, which should be a written table: every table reads it.

    Scores of removed rounds and shooters go, substitutes of removed shooters become NULL,
    as do leagues and teams that accounts and teams refer to.
    """
    done = report.filter("outcome = 'deleted'")

    def of(kind: str, name: str = "id") -> DataFrame:
        return done.filter(F.col("kind") == kind).select(F.col("id").alias(name))

    teams = of("team", "team_id")
    rounds = of("round").unionByName(tables["rounds"].join(teams, "team_id", "left_semi").select(F.col("id").cast("bigint").alias("id"))).distinct()
    shooters = of("shooter").unionByName(
        tables["shooters"].join(teams, "team_id", "left_semi").select(F.col("id").cast("bigint").alias("id"))
    ).distinct()
    return {
        "leagues": tables["leagues"].join(of("league"), "id", "left_anti"),
        "teams": maintain.without_leagues(tables["teams"].join(of("team"), "id", "left_anti"), of("league")),
        "users": tables["users"].join(of("user"), "id", "left_anti"),
        "rounds": tables["rounds"].join(rounds, "id", "left_anti"),
        "shooters": tables["shooters"].join(shooters, "id", "left_anti"),
        "scores": maintain.without_shooters(maintain.without_rounds(tables["scores"], rounds), shooters),
    }
