"""Edits of the stored tables: patches, replacements, keyed inserts, deletes, accounts, upgrades.

Every function takes tables and returns new tables; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.functions.exprs import blank_to_null, spread_null_id, spread_null_name, trimmed
from tallyline.operators.skew import allocate_ids
from tallyline.session import stage

DEFAULT_TEAM = "Default Team"
LEAGUE_TEXTS = (
    "location", "contact_name", "contact_email", "contact_phone", "schedule_text", "costs_text", "description",
)
PROFILE_TEXTS = ("name", "phone", "address")
LOGO_PREFIX = "data:image/"


def _next_id(table: DataFrame) -> Column:
    """Highest id of ``table`` as a scalar subquery, 0 when it is empty."""
    return table.select(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()


def _unknown(rows: DataFrame, column: str, parents: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``_unknown_<column>``: whether the column names a parent that is not stored. NULL names none.

    ``by`` is a column that tells rows apart, for rows that name none.
    """
    known = parents.select(F.col("id").alias("_parent"), F.lit(True).alias("_stored_parent"))
    key = spread_null_id(column, by)
    joined = rows.join(known, key == F.col("_parent"), "left")
    flag = F.col(column).isNotNull() & F.col("_stored_parent").isNull()
    return joined.withColumn(f"_unknown_{column}", flag).drop("_parent", "_stored_parent")


# --- patches and replacements ------------------------------------------------


def apply_patch(table: DataFrame, patch: DataFrame, columns: Mapping[str, Column], key: str = "id") -> DataFrame:
    """Overwrite ``columns`` of the rows that have a row in ``patch`` (one per key).

    Each column maps to the value it takes, over the joined row; the patch side
    is ``p``, the stored side ``t``. ``p.<column>_set`` says whether a column was
    supplied; a column that was not keeps its value.
    """
    joined = table.alias("t").join(patch.withColumn("_hit", F.lit(True)).alias("p"), key, "left")
    values = []
    for name in table.columns:
        if name == key:
            values.append(F.col(key))
        elif name in columns:
            supplied = F.col("p._hit") & F.coalesce(F.col(f"p.{name}_set"), F.lit(False))
            values.append(F.when(supplied, columns[name]).otherwise(F.col(f"t.{name}")).alias(name))
        else:
            values.append(F.col(f"t.{name}"))
    return joined.select(*values)


USER_FLAGS = ("is_admin", "is_squad_leader", "team_approved")


def patch_users(users: DataFrame, patch: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set flags and teams of accounts; (users, report).

    Flags are set where a value is supplied; a supplied NULL is ignored. A supplied
    team of NULL or 0 clears the team, one that is not stored refuses the whole change.
    """
    given = {f"{c}_set": F.coalesce(F.col(f"{c}_set"), F.lit(False)) & F.col(c).isNotNull() for c in USER_FLAGS}
    wanted = F.when(F.coalesce("team_id_set", F.lit(False)), F.nullif(F.col("team_id"), F.lit(0)))
    asked = _unknown(patch.withColumns({**given, "team_id": wanted}), "team_id", teams, "id")
    anything = F.coalesce("team_id_set", F.lit(False))
    for c in USER_FLAGS:
        anything = anything | F.col(f"{c}_set")
    outcome = (
        F.when(~anything, "nothing_to_update")
        .when(F.col("_unknown_team_id"), "unknown_team")
        .when(F.col("_known").isNull(), "not_found")
        .otherwise("updated")
    )
    judged = asked.join(users.select("id", F.lit(True).alias("_known")), "id", "left").withColumn("outcome", outcome)
    rules = {c: F.col(f"p.{c}") for c in (*USER_FLAGS, "team_id")}
    return apply_patch(users, judged.filter("outcome = 'updated'"), rules), judged.select("id", "outcome")


def _refused_keys(asked: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids of ``asked`` (id, keys) whose key another stored row holds or a lower id asks for too.

    All requests are held against the table as it was, so the ones let through
    can never collide, whichever others are refused.
    """
    holder = stored.select(*keys, F.col("id").alias("holder"))
    first = asked.groupBy(*keys).agg(F.min("id").alias("first_id"))
    refused = F.when(F.col("holder").isNotNull(), F.col("holder") != F.col("id")).otherwise(
        F.col("first_id") != F.col("id")
    )
    return asked.join(holder, list(keys), "left").join(first, list(keys)).filter(refused).select("id")


def patch_teams(teams: DataFrame, patch: DataFrame, leagues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename teams and set, clear or keep their league; (teams, report).

    A blank name or an unknown league refuses the change, a taken name is a
    conflict; all leave the row as it was. An omitted league stays, a league of
    NULL or 0 is cleared. Names are held against the table as it was before all
    requests: a name that another row gives up in the same batch is still taken.
    """
    wanted = F.when(F.coalesce("league_id_set", F.lit(False)), F.nullif(F.col("league_id"), F.lit(0)))
    asked = patch.withColumns(
        {"name": trimmed(F.coalesce("name", F.lit(""))), "name_set": F.lit(True), "league_id": wanted}
    )
    asked = _unknown(asked, "league_id", leagues, "id")
    known = asked.filter("name <> '' AND NOT _unknown_league_id").join(teams.select("id"), "id", "left_semi")
    refused = _refused_keys(known.select("id", "name"), teams, ["name"])
    rules = {"name": F.col("p.name"), "league_id": F.col("p.league_id")}
    outcome = (
        F.when(F.col("name") == "", "name_required")
        .when(F.col("_known").isNull(), "not_found")
        .when(F.col("_unknown_league_id"), "unknown_league")
        .when(F.col("_refused").isNotNull(), "conflict")
        .otherwise("updated")
    )
    report = (
        asked.join(teams.select("id", F.lit(True).alias("_known")), "id", "left")
        .join(refused.withColumn("_refused", F.lit(True)), "id", "left")
        .select("id", "name", outcome.alias("outcome"))
    )
    return apply_patch(teams, known.join(refused, "id", "left_anti"), rules), report


def patch_shooters(shooters: DataFrame, patch: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename or move shooters; (shooters, report). Scores follow, as they refer to the id.

    Blank names and NULL teams mean "keep". An unknown team refuses the change, a
    (team, name) already taken is a conflict.
    """
    asked = patch.select("id", blank_to_null("name").alias("name"), "team_id").withColumns(
        {"name_set": F.col("name").isNotNull(), "team_id_set": F.col("team_id").isNotNull()}
    )
    asked = _unknown(asked, "team_id", teams, "id")
    known = asked.filter("(name_set OR team_id_set) AND NOT _unknown_team_id").join(shooters.select("id"), "id", "left_semi")
    rules = {"name": F.col("p.name"), "team_id": F.col("p.team_id")}
    wanted = apply_patch(shooters.join(known.select("id"), "id", "left_semi"), known, rules)
    refused = _refused_keys(wanted.select("id", "team_id", "name"), shooters, ["team_id", "name"])
    outcome = (
        F.when(~(F.col("name_set") | F.col("team_id_set")), "nothing_to_update")
        .when(F.col("_known").isNull(), "not_found")
        .when(F.col("_unknown_team_id"), "unknown_team")
        .when(F.col("_refused").isNotNull(), "conflict")
        .otherwise("updated")
    )
    report = (
        asked.join(shooters.select("id", F.lit(True).alias("_known")), "id", "left")
        .join(refused.withColumn("_refused", F.lit(True)), "id", "left")
        .select("id", outcome.alias("outcome"))
    )
    return apply_patch(shooters, known.join(refused, "id", "left_anti"), rules), report


def patch_logos(logos: DataFrame, requests: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set or clear team logos; (logos, report).

    ``requests``: seq, team_id, logo_data, is_admin, is_squad_leader, own_team_id.
    Admins may change any team, leaders their own; the last good request of a
    team stays. NULL clears; anything else, the empty text included, must be an
    image data URL. Requests for unknown teams are answered ``not_found``.
    """
    allowed = F.col("is_admin") | (
        F.col("is_squad_leader") & F.coalesce(F.col("own_team_id") == F.col("team_id"), F.lit(False))
    )
    fine = F.col("logo_data").isNull() | F.startswith("logo_data", F.lit(LOGO_PREFIX))
    judged = _unknown(requests, "team_id", teams, "seq").withColumn(
        "outcome",
        F.when(~allowed, "forbidden")
        .when(~fine, "not_an_image")
        .when(F.col("_unknown_team_id") | F.col("team_id").isNull(), "not_found")
        .when(F.col("logo_data").isNull(), "cleared")
        .otherwise("set"),
    )
    good = judged.filter(F.col("outcome").isin("set", "cleared"))
    last = good.groupBy("team_id").agg(F.max("seq").alias("seq"))
    done = good.join(last, ["team_id", "seq"], "left_semi").select("team_id", "logo_data")
    kept = logos.join(last, "team_id", "left_anti")
    return kept.unionByName(done.filter("logo_data IS NOT NULL")), judged.select("seq", "team_id", "outcome")


def replace_texts(table: DataFrame, values: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Full replace: every listed column takes the trimmed new text, blank or missing as NULL."""
    given = [c for c in columns if c in values.columns]
    new = values.select(
        key,
        *[blank_to_null(c).alias(f"_new_{c}") for c in given],
        F.lit(True).alias("_hit"),
    )
    joined = table.join(new, key, "left")
    out = {}
    for c in columns:
        old = F.col(c) if c in table.columns else F.lit(None).cast("string")
        out[c] = F.when(F.col("_hit"), F.col(f"_new_{c}") if c in given else F.lit(None)).otherwise(old)
    return joined.withColumns(out).drop("_hit", *[f"_new_{c}" for c in given])


def replace_leagues(leagues: DataFrame, values: DataFrame) -> DataFrame:
    """Leagues with all information texts replaced.

    With a ``name`` column, rows whose new name is blank or taken are refused
    whole. Without one the names stay.
    """
    if "name" in values.columns:
        values = values.withColumn("name", blank_to_null("name")).filter("name IS NOT NULL")
        values = values.join(leagues.select("id"), "id", "left_semi")
        values = values.join(_refused_keys(values.select("id", "name"), leagues, ["name"]), "id", "left_anti")
        renamed = values.select("id", "name", F.lit(True).alias("name_set"))
        leagues = apply_patch(leagues, renamed, {"name": F.col("p.name")})
    return replace_texts(leagues, values, LEAGUE_TEXTS)


def replace_profiles(users: DataFrame, values: DataFrame) -> DataFrame:
    """Accounts with name, phone and address replaced by what their owners sent (id, texts)."""
    return replace_texts(users, values, PROFILE_TEXTS)


# --- keyed inserts -------------------------------------------------------------


def insert_shooters(requests: DataFrame, shooters: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add shooters (team_id, raw_name, plus an ordering pair submission_id, pos); (shooters, report).

    The report has one row per (team, name): the first request is inserted unless
    the name is taken or the team unknown; every other one is a conflict. A blank
    name and a team of NULL or 0 are invalid. Requests are counted before the
    shuffle, so a name asked for many times costs little.
    """
    asked = requests.select("team_id", trimmed(F.coalesce("raw_name", F.lit(""))).alias("name"), "submission_id", "pos")
    per_name = asked.groupBy("team_id", "name").agg(
        F.count(F.lit(1)).alias("attempts"), F.min(F.struct("submission_id", "pos")).alias("first")
    )
    taken = shooters.select("team_id", "name", F.lit(True).alias("taken"))
    invalid = (F.col("name") == "") | (F.coalesce("team_id", F.lit(0)) == 0)
    judged = _unknown(per_name, "team_id", teams, "name").join(taken, ["team_id", "name"], "left").withColumn(
        "outcome",
        F.when(invalid, "invalid").when(F.col("_unknown_team_id"), "unknown_team").when(F.col("taken"), "conflict")
        .otherwise("inserted"),
    )
    refused = (
        F.when(F.col("outcome") == "inserted", F.col("attempts") - 1)
        .when(F.col("outcome") == "conflict", F.col("attempts"))
        .otherwise(0)
    )
    fresh = judged.filter("outcome = 'inserted'").select("team_id", "name")
    added = allocate_ids(fresh, ["team_id", "name"], _next_id(shooters))
    report = judged.select(
        "team_id", "name", "outcome", "attempts", refused.alias("conflicts"),
        F.col("first.submission_id").alias("first_submission_id"), F.col("first.pos").alias("first_pos"),
    )
    return shooters.unionByName(added, allowMissingColumns=True), report


def upsert_teams(names: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams with missing names (column ``name``) added; existing rows keep their id."""
    fresh = (
        names.select(blank_to_null("name").alias("name"))
        .filter("name IS NOT NULL")
        .distinct()
        .join(teams.select("name"), "name", "left_anti")
    )
    added = allocate_ids(fresh, ["name"], _next_id(teams)).withColumn("id", F.col("id").cast("int"))
    return teams.unionByName(added, allowMissingColumns=True)


def insert_leagues(requests: DataFrame, leagues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add leagues (seq, name, information texts); (leagues, report). A taken name is a conflict."""
    texts = [c for c in LEAGUE_TEXTS if c in requests.columns]
    asked = requests.select("seq", blank_to_null("name").alias("name"), *[blank_to_null(c).alias(c) for c in texts])
    first = asked.groupBy("name").agg(F.min("seq").alias("first_seq"))
    judged = asked.join(first, "name", "left").join(
        leagues.select("name", F.lit(True).alias("taken")), "name", "left"
    )
    outcome = (
        F.when(F.col("name").isNull(), "name_required")
        .when(F.col("taken") | (F.col("seq") != F.col("first_seq")), "conflict")
        .otherwise("inserted")
    )
    judged = judged.withColumn("outcome", outcome)
    fresh = judged.filter("outcome = 'inserted'").select("name", *texts)
    added = allocate_ids(fresh, ["name"], _next_id(leagues)).withColumn("id", F.col("id").cast("int"))
    return leagues.unionByName(added, allowMissingColumns=True), judged.select("seq", "name", "outcome")


# --- deletes -------------------------------------------------------------------


def without_rounds(scores: DataFrame, gone: DataFrame) -> DataFrame:
    """Scores that stay when the rounds in ``gone`` (id) are deleted."""
    return scores.join(gone.select(F.col("id").alias("round_id")), "round_id", "left_anti")


def without_shooters(scores: DataFrame, gone: DataFrame) -> DataFrame:
    """Scores that stay when shooters are deleted: their own go, references to them become NULL."""
    own = gone.select(F.col("id").alias("shooter_id"))
    subbed = gone.select(F.col("id").alias("_gone"))
    key = spread_null_id("sub_for_shooter_id", "round_id", "shooter_id", "total")
    return (
        scores.join(own, "shooter_id", "left_anti")
        .join(subbed, key == F.col("_gone"), "left")
        .withColumn("sub_for_shooter_id", F.when(F.col("_gone").isNull(), F.col("sub_for_shooter_id")))
        .drop("_gone")
    )


def own_rounds(wanted: DataFrame, rounds: DataFrame, team_id: int) -> DataFrame:
    """The rounds of ``wanted`` a member of ``team_id`` may delete: only their own team's."""
    mine = rounds.filter(F.col("team_id") == team_id).select("id")
    return wanted.select("id").join(mine, "id", "left_semi")


def deletable_teams(wanted: DataFrame, users: DataFrame) -> DataFrame:
    """Teams of ``wanted`` (id) that no account belongs to any more."""
    return wanted.select("id").join(users.select(F.col("team_id").alias("id")), "id", "left_anti")


def delete_teams(
    wanted: DataFrame, teams: DataFrame, shooters: DataFrame, rounds: DataFrame, scores: DataFrame, users: DataFrame
) -> dict[str, DataFrame]:
    """All tables after deleting teams with everything that hangs on them; teams with members stay."""
    gone = deletable_teams(wanted, users)
    by_team = gone.withColumnRenamed("id", "team_id")
    gone_shooters = shooters.join(by_team, "team_id", "left_semi").select("id")
    gone_rounds = rounds.join(by_team, "team_id", "left_semi").select("id")
    return {
        "teams": teams.join(gone, "id", "left_anti"),
        "shooters": shooters.join(by_team, "team_id", "left_anti"),
        "rounds": rounds.join(by_team, "team_id", "left_anti"),
        "scores": without_shooters(without_rounds(scores, gone_rounds), gone_shooters),
    }


def team_delete_report(wanted: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    """Every wanted team with the outcome: deleted, has_members or not_found."""
    members = users.groupBy(F.col("team_id").alias("id")).agg(F.count(F.lit(1)).alias("members"))
    outcome = (
        F.when(F.col("members") > 0, "has_members").when(F.col("name").isNull(), "not_found").otherwise("deleted")
    )
    return (
        wanted.select("id")
        .join(teams.select("id", "name"), "id", "left")
        .join(members, "id", "left")
        .select("id", "name", F.coalesce("members", F.lit(0)).alias("members"), outcome.alias("outcome"))
    )


def without_leagues(teams: DataFrame, gone: DataFrame) -> DataFrame:
    """Teams after deleting leagues: the teams stay, without a league."""
    left = gone.select(F.col("id").alias("league_id"), F.lit(True).alias("_gone"))
    return (
        teams.join(left, "league_id", "left")
        .withColumn("league_id", F.when(F.col("_gone").isNull(), F.col("league_id")))
        .select(*teams.columns)
    )


def without_users(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Accounts after deletes (id, requested_by); nobody removes their own."""
    gone = wanted.filter(F.col("id") != F.col("requested_by")).select("id")
    return users.join(gone, "id", "left_anti")


# --- accounts --------------------------------------------------------------------


def account_intake(
    applicants: DataFrame, users: DataFrame, teams: DataFrame, registration_open: bool = True
) -> DataFrame:
    """Outcome of every application (seq, raw_email, raw_name, team_id, new_team_name), in order of ``seq``.

    The first account on an empty site is admin and approved. Naming a new team
    makes the applicant its approved leader, even when a team of that name
    already exists (``names_existing_team``). The earliest of several applications
    with one email wins; one that is refused for a faulty email or an unknown team
    does not count. A team of 0 means none.
    """
    email = F.lower(trimmed(F.coalesce("raw_email", F.lit(""))))
    new_team = blank_to_null("new_team_name")
    name = blank_to_null("raw_name") if "raw_name" in applicants.columns else F.lit(None).cast("string")
    joins = F.when(F.col("new_team").isNull(), F.nullif(F.col("asked"), F.lit(0)))
    clean = applicants.select(
        "seq", email.alias("email"), name.alias("name"), F.col("team_id").alias("asked"), new_team.alias("new_team")
    ).withColumn("team_id", joins)
    clean = _unknown(clean, "team_id", teams, "seq")
    has_email = F.contains(F.col("email"), F.lit("@"))
    valid = has_email & ~F.col("_unknown_team_id")
    stored = users.select("email", F.lit(True).alias("_stored"))
    named = teams.select(F.col("name").alias("known_team"))
    # Counted before the shuffle, so an email repeated very often stays cheap.
    first = clean.filter(valid).groupBy("email").agg(F.min("seq").alias("first_seq"))
    site_empty = users.select(F.count(F.lit(1)) == 0).scalar()
    opener = clean.filter(valid).select(F.min("seq")).scalar()
    is_first = site_empty & (F.col("seq") == opener)
    before_opener = site_empty & (F.col("seq") < F.coalesce(opener, F.col("seq") + 1))
    outcome = (
        F.when(~has_email, "invalid_email")
        .when(~(is_first | before_opener | F.lit(registration_open)), "registration_closed")
        .when(F.col("_stored").isNotNull() | (F.col("seq") > F.col("first_seq")), "email_taken")
        .when(F.col("_unknown_team_id"), "unknown_team")
        .otherwise("created")
    )
    judged = (
        clean.join(first, "email", "left")
        .join(stored, "email", "left")
        .join(named, spread_null_name("new_team", "seq") == F.col("known_team"), "left")
        .withColumn("first_account", F.coalesce(is_first, F.lit(False)))
        .withColumn("outcome", outcome)
    )
    made = F.col("outcome") == "created"
    founds = F.col("new_team").isNotNull()
    return judged.select(
        "seq",
        "email",
        F.when(made, F.col("name")).alias("name"),
        "outcome",
        F.when(made, F.col("new_team")).alias("new_team"),
        F.when(made, F.col("team_id")).alias("joined_team_id"),
        F.when(made, F.col("first_account")).alias("is_admin"),
        F.when(made, founds).alias("is_squad_leader"),
        F.when(made, F.col("first_account") | founds | F.col("team_id").isNull()).alias("team_approved"),
        F.when(made, founds & F.col("known_team").isNotNull()).alias("names_existing_team"),
    )


def users_after_intake(
    intake: DataFrame, users: DataFrame, teams: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(users, teams) with the accounts and teams that ``intake`` (of ``account_intake``) makes. Both get ids."""
    made = stage(intake.filter("outcome = 'created'"), "new-accounts")
    all_teams = stage(upsert_teams(made.select(F.col("new_team").alias("name")), teams), "teams-after-intake")
    founded = all_teams.select(F.col("name").alias("_team"), F.col("id").alias("_founded_id"))
    rows = made.join(founded, spread_null_name("new_team", "seq") == F.col("_team"), "left").select(
        "email", "name", "is_admin", "is_squad_leader", "team_approved",
        F.coalesce("_founded_id", "joined_team_id").alias("team_id"),
    )
    added = allocate_ids(rows, ["email"], _next_id(users))
    return users.unionByName(added, allowMissingColumns=True), all_teams


# Sign-ins of one email that are looked at together, by number.
SIGN_INS = 65_536


def identity_match(identities: DataFrame, users: DataFrame, registration_open: bool = True) -> DataFrame:
    """Match sign-ins from outside (seq, external_id, raw_email, email_verified) to accounts, in order of ``seq``.

    The external id decides first, then the normalised verified email (the id is
    then linked, in place of the one linked before), else a new account without a
    team is made. An account holds one external id: when another one signs in with its
    email, the first must link again by email. An external id is taken to come
    with one email throughout a batch. ``seq`` is unique and not negative.
    """
    checked = identities.select(
        "seq", "external_id", F.lower(trimmed("raw_email")).alias("email"),
        (F.coalesce("email_verified", F.lit(False)) & (F.coalesce("raw_email", F.lit("")) != "")).alias("ok"),
    )
    seen = stage(checked.withColumn("slice", F.floor(F.col("seq") / SIGN_INS)), "checked-sign-ins")
    accounts = users.select(F.count(F.lit(1)) == 0).scalar()
    opener = seen.filter("ok").select(F.min("seq")).scalar()
    by_email = users.select("email", F.col("id").alias("email_user"), F.col("google_id").alias("held"))
    by_id = users.filter("google_id IS NOT NULL").select(
        F.col("google_id").alias("external_id"), F.col("id").alias("id_user"), F.col("email").alias("id_email")
    )
    known = seen.filter("ok").join(by_email, "email", "left")
    # When each account's stored id was first replaced.
    replaced = known.filter("external_id <> held").groupBy(F.col("email").alias("id_email")).agg(F.min("seq").alias("replaced_at"))
    home_of = by_id.join(replaced, "id_email", "left")
    at_home = F.col("id_user").isNotNull() & (F.col("seq") < F.coalesce("replaced_at", F.col("seq") + 1))
    # Read twice below, by the sign-ins themselves and by what one slice hands on to the next.
    homes = stage(known.join(home_of, "external_id", "left").withColumn("home", at_home), "sign-in-accounts")
    # Signing in to an account with another email does not touch the one with this email.
    elsewhere = F.col("home") & (F.col("id_email") != F.col("email"))
    here = F.when(~elsewhere, F.col("seq"))
    turn = W.partitionBy("email", "slice").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    own_id = F.when(~elsewhere, F.col("external_id"))
    inside = F.last(own_id, ignorenulls=True).over(turn)
    # The id of the sign-in before, for the same email: within a slice, or the last one of the slices before.
    ends = homes.groupBy("email", "slice").agg(F.max_by("external_id", here).alias("last"), F.min(here).alias("first"))
    earlier = W.partitionBy("email").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(
        "email", "slice", F.last("last", ignorenulls=True).over(earlier).alias("carried"),
        F.min("first").over(W.partitionBy("email")).alias("first_seq"),
    )
    joined = homes.withColumn("inside", inside).join(ends, ["email", "slice"]).withColumn(
        "before", F.coalesce("inside", "carried", F.when(F.col("home"), F.col("external_id")))
    )
    may_open = F.lit(registration_open) | (accounts & (F.col("first_seq") == opener))
    outcome = (
        F.when(elsewhere, "signed_in")
        .when(F.col("email_user").isNull() & ~may_open, "registration_closed")
        .when(F.col("email_user").isNull() & (F.col("seq") == F.col("first_seq")), "created")
        .when(F.col("before") == F.col("external_id"), "signed_in")
        .otherwise("linked")
    )
    judged = joined.select(
        "seq", "external_id", "email", F.when(elsewhere, F.col("id_user")).otherwise(F.col("email_user")).alias("user_id"),
        outcome.alias("outcome"),
    )
    rejected = seen.filter("NOT ok").select(
        "seq", "external_id", "email", F.lit(None).cast("bigint").alias("user_id"), F.lit("rejected").alias("outcome")
    )
    return judged.unionByName(rejected)


def users_after_sign_in(matched: DataFrame, identities: DataFrame, users: DataFrame) -> DataFrame:
    """Accounts after ``matched`` (of ``identity_match``): linked ids stored, new accounts added with ids.

    ``identities`` may have ``raw_name``, the name a new account gets: without white space at its ends, so
    a name of white space alone is the empty text. NULL and the empty text mean none.
    """
    matched = stage(matched, "sign-ins")
    tied = matched.filter(F.col("outcome").isin("linked", "created")).groupBy("email").agg(
        F.max_by("external_id", "seq").alias("_linked")
    )
    name = F.lit(None).cast("string")
    if "raw_name" in identities.columns:
        name = F.when(F.col("raw_name") != "", trimmed("raw_name"))
    names = identities.select("seq", name.alias("name"))
    made = matched.filter("outcome = 'created'").select("seq", "email").join(names, "seq").join(tied, "email")
    first = users.select(F.count(F.lit(1)) == 0).scalar()
    new = made.select(
        "email", F.col("_linked").alias("google_id"), "name", first.alias("is_admin"),
        F.lit(False).alias("is_squad_leader"), F.lit(True).alias("team_approved"),
    )
    kept = users.join(tied, "email", "left").withColumn("google_id", F.coalesce("_linked", "google_id"))
    added = allocate_ids(new, ["email"], _next_id(users))
    return kept.select(*users.columns).unionByName(added, allowMissingColumns=True)


# --- schema upgrades ---------------------------------------------------------------

# Columns added to the tables over time, with the value older rows get.
ADDED_COLUMNS: dict[str, dict[str, tuple[str, object]]] = {
    "rounds": {"team_id": ("int", None), "yardage": ("smallint", None), "round_number": ("smallint", 1)},
    "scores": {"sub_for_shooter_id": ("bigint", None)},
    "shooters": {"team_id": ("int", None)},
    "teams": {"league_id": ("int", None), "logo_data": ("string", None)},
    "users": {
        "name": ("string", None),
        "phone": ("string", None),
        "address": ("string", None),
        "google_id": ("string", None),
        "is_squad_leader": ("boolean", False),
        "team_approved": ("boolean", True),
    },
}


def upgrade(old: DataFrame, table: str) -> DataFrame:
    """Add the columns ``old`` lacks and fill defaults where a newer file left a gap."""
    filled = {n: d for n, (_, d) in ADDED_COLUMNS[table].items() if d is not None and n in old.columns}
    return added_columns(old.na.fill(filled) if filled else old, table)


def added_columns(old: DataFrame, table: str) -> DataFrame:
    """Add the columns that ``old``, rows from before they were there, lacks, with their defaults."""
    new = {n: F.lit(d).cast(k) for n, (k, d) in ADDED_COLUMNS[table].items() if n not in old.columns}
    return old.withColumns(new) if new else old


def with_default_team(teams: DataFrame) -> DataFrame:
    """Teams with the default team present."""
    missing = (
        teams.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.count_if(F.col("name") == DEFAULT_TEAM).alias("n"))
        .filter("n = 0")
        .select((F.col("top") + 1).cast("int").alias("id"), F.lit(DEFAULT_TEAM).alias("name"))
    )
    return teams.unionByName(missing, allowMissingColumns=True)


def backfill_team(table: DataFrame, teams: DataFrame) -> DataFrame:
    """Rows without a team get the default team, which must be in ``teams``."""
    default = teams.filter(F.col("name") == DEFAULT_TEAM).select(F.max("id")).scalar()
    return table.withColumn("team_id", F.coalesce("team_id", default.cast("int")))


# --- constraints -------------------------------------------------------------------

NOT_NULL = {
    "leagues": ("id", "name"),
    "teams": ("id", "name"),
    "users": ("id", "email", "is_admin", "is_squad_leader", "team_approved", "created_at"),
    "shooters": ("id", "team_id", "name"),
    "rounds": ("id", "team_id", "round_date", "round_number"),
    "scores": ("round_id", "shooter_id", "total"),
}
UNIQUE = {
    "leagues": (("id",), ("name",)),
    "teams": (("id",), ("name",)),
    "users": (("id",), ("email",), ("google_id",)),
    "shooters": (("id",), ("team_id", "name")),
    "rounds": (("id",),),
}
FOREIGN = (
    ("teams", "league_id", "leagues"),
    ("users", "team_id", "teams"),
    ("shooters", "team_id", "teams"),
    ("rounds", "team_id", "teams"),
    ("scores", "round_id", "rounds"),
    ("scores", "shooter_id", "shooters"),
    ("scores", "sub_for_shooter_id", "shooters"),
)


LOGO_RULE = "logo_data is an image"


def _checks(table: str) -> list[Column]:
    """What one row of ``table`` says about each rule: structs (rule, number, text, child, parent), NULL where it is silent."""

    def said(table: str, rule: str, keys: Sequence[Column], child: int, parent: int, when: Column) -> Column:
        # Ids go as numbers, all other keys as text.
        by_id = len(keys) == 1 and rule not in ("unique name", "unique email", "unique google_id")
        number = keys[0].cast("bigint") if by_id else F.lit(None).cast("bigint")
        text = F.to_json(F.array(*[k.cast("string") for k in keys])) if keys and not by_id else F.lit(None).cast("string")
        return F.when(when, F.struct(
            F.lit(f"{table}: {rule}").alias("rule"), number.alias("number"), text.alias("text"),
            F.lit(child).alias("child"), F.lit(parent).alias("parent"),
        ))

    out = [said(table, f"not null {c}", [], 1, 0, F.col(c).isNull()) for c in NOT_NULL[table]]
    for keys in UNIQUE.get(table, ()):
        filled = F.lit(True)
        for k in keys:
            filled = filled & F.col(k).isNotNull()
        out.append(said(table, "unique " + ",".join(keys), [F.col(k) for k in keys], 1, 0, filled))
    for child, column, parent in FOREIGN:
        if child == table:
            out.append(said(table, f"{column} in {parent}", [F.col(column)], 1, 0, F.col(column).isNotNull()))
        if parent == table:
            out.append(said(child, f"{column} in {parent}", [F.col("id")], 0, 1, F.col("id").isNotNull()))
    return out


def constraint_violations(tables: Mapping[str, DataFrame], logos: DataFrame | None = None) -> DataFrame:
    """Rows that break each rule of the schema, one result row per rule.

    Every table is read once. Each row says which keys it holds and which it
    refers to; these are added up per (rule, key) before the one shuffle, so no
    key's rows meet in one task, and a key with children but without a parent shows.
    """
    said = None
    for name in NOT_NULL:
        rows = tables[name].select(F.explode(F.array_compact(F.array(*_checks(name)))).alias("x")).select("x.*")
        said = rows if said is None else said.unionByName(rows)
    keys = said.groupBy("rule", "number", "text").agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
    broken = (
        F.when(F.col("rule").contains(": unique "), F.col("children") - 1)
        .when(F.col("rule").contains(": not null "), F.col("children"))
        .when(F.col("parent") == 0, F.col("children"))
        .otherwise(0)
    )
    found = keys.groupBy("rule").agg(F.sum(broken).alias("violations"))
    if logos is not None:
        wrong = F.count_if(~F.startswith("logo_data", F.lit(LOGO_PREFIX)))
        found = found.unionByName(logos.agg(wrong.alias("violations")).select(F.lit(f"teams: {LOGO_RULE}").alias("rule"), "violations"))
    names = [f"{t}: not null {c}" for t, columns in NOT_NULL.items() for c in columns]
    names += [f"{t}: unique {','.join(k)}" for t, groups in UNIQUE.items() for k in groups]
    names += [f"{t}: {c} in {p}" for t, c, p in FOREIGN] + ([f"teams: {LOGO_RULE}"] if logos is not None else [])
    spark = said.sparkSession
    # Rules no row has anything to say about hold.
    rules = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("rule"))
    parts = F.split("rule", ": ", 2)
    return rules.join(found, "rule", "left").select(
        parts[0].alias("table_name"), parts[1].alias("rule"), F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations")
    )
