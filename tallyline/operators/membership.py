"""Membership requests applied in their order, for all members at once.

A member's requests depend on each other: joining works for accounts without a
team only, and approvals and denials only for the team the account is on. So what
counts is a chain: a join holds until the next denial by its team, and the next
join after that counts again. Where each join leads is looked up for all of them at
once; the chain from a member's first state is then followed by doubling its steps, and every request
finds the join in force before it. No row holds more than one request, however many a member has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.exprs import blank_to_null, spread_null_id, spread_null_name
from tallyline.operators.maintain import upsert_teams
from tallyline.operators.skew import event_after, event_before
from tallyline.session import stage

#: Request numbers that one task looks at together, per member.
BLOCK = 65_536
# Teams are known ids ("#3") or names to be founded ("+Name"); none is the empty text.
NO_TEAM = ""
#: A member's own state before all requests.
START = -1


def _checked(requests: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """Requests with ``kind``, ``team`` (a known id or a new name) and ``fault``, and their member's account.

    A name, where one is given, founds a team or takes the team of that name;
    without one a request to create is one to join.
    """
    name = blank_to_null("team_name")
    asked = requests.select(
        "seq", "user_id", "action", name.alias("name"), F.nullif(F.col("team_id"), F.lit(0)).alias("asked"),
    )
    naming = F.col("action").isin("join", "create") & F.col("name").isNotNull()
    kind = F.when(F.col("action").isin("join", "create"), F.when(naming, "create").otherwise("join")).otherwise(F.col("action"))
    named = teams.select(F.col("name").alias("_name"), F.col("id").alias("_named_id"))
    known = teams.select(F.col("id").alias("_known_id"))
    members = users.select(F.col("id").alias("_user"), "is_admin")
    rows = (
        asked.withColumn("kind", kind)
        .join(named, spread_null_name("name", "seq") == F.col("_name"), "left")
        .join(known, spread_null_id("asked", "seq") == F.col("_known_id"), "left")
        .join(members, spread_null_id("user_id", "seq") == F.col("_user"), "left")
    )
    by_name = F.when(F.col("_named_id").isNotNull(), F.concat(F.lit("#"), F.col("_named_id").cast("string"))).otherwise(
        F.concat(F.lit("+"), F.col("name"))
    )
    fault = (
        F.when(F.col("_user").isNull(), "unknown_user")
        .when(~F.coalesce(F.col("kind").isin("join", "create", "approve", "deny"), F.lit(False)), "unknown_action")
        .when((F.col("kind") == "join") & F.col("asked").isNull(), "no_team_given")
        .when((F.col("kind") == "join") & F.col("_known_id").isNull(), "unknown_team")
        .when(F.col("kind").isin("approve", "deny") & F.col("asked").isNull(), "other_team")
    )
    return rows.select(
        "seq", F.col("user_id").cast("long").alias("user_id"), "action", "kind",
        F.when(F.col("kind") == "create", by_name).otherwise(F.concat(F.lit("#"), F.col("asked").cast("string"))).alias("team"),
        "is_admin", fault.alias("fault"),
    )


def _joins(kind: str = "kind") -> Column:
    return F.col(kind).isin("join", "create")


def _steps(rows: DataFrame, width: int) -> DataFrame:
    """(user_id, pos, team, kind, is_admin, released, onward) of every join and every start.

    ``released`` is the denial that ends it, if any, and ``onward`` the next join after that.
    A start without a team is over at once.
    """
    denied = event_after(rows, ["user_id", "team"], F.when(F.col("kind") == "deny", F.col("pos")), "denied", width)
    released = F.when((F.col("kind") == "start") & (F.col("team") == NO_TEAM), F.col("pos")).otherwise(F.col("denied"))
    after = event_after(
        rows.filter(_joins() | (F.col("kind") == "deny") | (F.col("kind") == "start")), ["user_id"],
        F.when(_joins(), F.col("pos")), "onward", width,
    )
    after = after.filter((F.col("kind") == "deny") | (F.col("kind") == "start")).select(
        F.col("user_id").alias("_user"), F.col("pos").alias("_pos"), "onward"
    )
    held = denied.filter(_joins() | (F.col("kind") == "start")).withColumn("released", released).drop("denied")
    return held.join(
        after, (F.col("user_id") == F.col("_user")) & (F.col("released") == F.col("_pos")), "left"
    ).drop("_user", "_pos")


def _in_force(steps: DataFrame) -> DataFrame:
    """(user_id, pos) of the starts and of all joins that take effect.

    Each round reaches four times as far as all rounds before it, so there are as many as the logarithm of the
    longest chain. What a round finds, and the longer steps of the next one, are written tables.
    """
    on = steps.select("user_id", "pos", "onward")
    edges = on.filter("onward IS NOT NULL")
    reached = on.filter(F.col("pos") == START).select("user_id", "pos")
    while not edges.isEmpty():
        double = stage(_twice(edges), "membership-steps")
        once = _moved(reached, edges)
        found = once.unionByName(_moved(reached.unionByName(once), double))
        reached = reached.unionByName(stage(found, "membership-chain"))
        edges = stage(_twice(double), "membership-steps")
    return reached


def _moved(places: DataFrame, edges: DataFrame) -> DataFrame:
    return places.join(edges, ["user_id", "pos"]).select("user_id", F.col("onward").alias("pos"))


def _twice(edges: DataFrame) -> DataFrame:
    """The edges that two edges make together."""
    far = edges.select("user_id", F.col("pos").alias("onward"), F.col("onward").alias("_far"))
    return edges.join(far, ["user_id", "onward"]).select("user_id", "pos", F.col("_far").alias("onward"))


def apply_requests(
    users: DataFrame, requests: DataFrame, teams: DataFrame, width: int = BLOCK
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, outcomes, teams) after all ``requests``, each member's in order of ``seq``.

    ``requests``: seq (unique, not negative), user_id, action (join, create,
    approve, deny), team_id, team_name. Joining an unknown team, or none, is
    refused. A member who is on a team already cannot join or create; what the
    request names is then not looked at. Creating founds the named team
    if there is none of that name, and makes an approved leader, a title that is
    never taken away here. Approving and denying look at the team only, not at
    whether the member was still pending. ``outcomes`` has a row for every request.
    """
    checked = stage(_checked(requests, users, teams), "membership-requests")
    columns = ["user_id", F.col("seq").cast("long").alias("pos"), "kind", "team", "is_admin"]
    sound = checked.filter("user_id IS NOT NULL AND fault IS NULL").select(*columns)
    starts = users.select(
        F.col("id").cast("long").alias("user_id"), F.lit(START).cast("long").alias("pos"), F.lit("start").alias("kind"),
        F.coalesce(F.concat(F.lit("#"), F.col("team_id").cast("string")), F.lit(NO_TEAM)).alias("team"),
        F.col("is_admin"),
    ).join(checked.select("user_id").distinct(), "user_id", "left_semi")
    steps = stage(_steps(sound.unionByName(starts), width), "membership-joins")
    chain = stage(steps.join(_in_force(steps), ["user_id", "pos"], "left_semi"), "membership-in-force")

    # Only a member without a team is told what is wrong with the wish for one.
    faulty = checked.filter("fault IS NOT NULL")
    wish = (F.col("kind") == "join") & (F.col("fault") != "unknown_user")
    wishes = faulty.filter(wish).select(
        "user_id", F.col("seq").cast("long").alias("pos"), F.lit("wish").alias("kind"), F.col("fault").alias("team"), "is_admin"
    )
    none = F.lit(None)
    asked = sound.unionByName(wishes).withColumns({"held": none.cast("string"), "released": none.cast("long")})
    # The join in force comes to every request after it: its mark is behind the request itself.
    marks = chain.select(
        "user_id", "pos", F.lit("mark").alias("kind"), "team", "is_admin", F.col("team").alias("held"), "released"
    )
    is_mark = F.col("kind") == "mark"
    both = asked.unionByName(marks).withColumn("at", 2 * F.col("pos") + is_mark.cast("long"))
    mark = F.when(is_mark, F.struct("held", "released"))
    placed = event_before(both, ["user_id"], mark, "last", 2 * width, "at").filter(~is_mark)
    on = F.when(F.col("last.released").isNull() | (F.col("pos") <= F.col("last.released")), F.col("last.held")).otherwise(NO_TEAM)
    done = stage(
        placed.withColumn("on", on).select("user_id", "pos", "kind", "team", "is_admin", "on", _outcome().alias("outcome")),
        "membership-outcomes",
    )

    outcomes = done.select(F.col("pos").alias("seq"), "outcome").unionByName(
        faulty.filter(~F.coalesce(wish, F.lit(False))).select(F.col("seq").cast("long").alias("seq"), F.col("fault").alias("outcome"))
    )
    report = checked.select(F.col("seq").cast("long").alias("seq"), "user_id", "action").join(outcomes, "seq")
    founded = done.filter("outcome = 'created' AND team LIKE '+%'").select(F.expr("substring(team, 2)").alias("name"))
    all_teams = stage(upsert_teams(founded.distinct(), teams), "membership-teams")
    return _accounts(users, done, all_teams), report, all_teams


def _outcome() -> Column:
    """What becomes of a request of a member who is ``on`` a team."""
    free = F.col("on") == NO_TEAM
    return (
        F.when(F.col("kind").isin("join", "create", "wish") & ~free, "already_on_a_team")
        .when(F.col("kind") == "wish", F.col("team"))
        .when(F.col("kind") == "create", "created")
        .when(F.col("kind") == "join", F.when(F.col("is_admin"), "joined").otherwise("pending"))
        .when(free | (F.col("on") != F.col("team")), "other_team")
        .when(F.col("kind") == "approve", "approved")
        .otherwise("denied")
    )


def _accounts(users: DataFrame, done: DataFrame, teams: DataFrame) -> DataFrame:
    """Accounts after the last request of each that changed something."""
    told = F.col("outcome").isin("created", "joined", "pending", "approved", "denied")
    state = F.struct(
        F.when(F.col("outcome") != "denied", F.col("team")).otherwise(NO_TEAM).alias("team"),
        (F.col("outcome") != "pending").alias("approved"),
    )
    last = done.filter(told).groupBy(F.col("user_id").alias("_user")).agg(
        F.max_by(state, "pos").alias("s"), F.bool_or(F.col("outcome") == "created").alias("led")
    )
    ids = teams.select(F.col("name").alias("_name"), F.col("id").alias("_new_id"))
    rows = users.join(last, F.col("id").cast("long") == F.col("_user"), "left").withColumn(
        "_new", F.when(F.col("s.team").startswith("+"), F.expr("substring(s.team, 2)"))
    )
    rows = rows.join(ids, spread_null_name("_new", "id") == F.col("_name"), "left")
    kept = F.when(F.col("s.team").startswith("#"), F.expr("substring(s.team, 2)").cast("int"))
    out = {
        "team_id": F.when(F.col("s").isNull(), F.col("team_id")).otherwise(F.coalesce("_new_id", kept).cast("int")),
        "team_approved": F.coalesce("s.approved", "team_approved"),
        "is_squad_leader": F.col("is_squad_leader") | F.coalesce("led", F.lit(False)),
    }
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in users.columns])
