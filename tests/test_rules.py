"""Rules the test tables do not reach, on small hand-written frames."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions import exprs, jsontext
from tallyline.operators import derived, directory, ingest, maintain, membership, reads, skew
from tallyline.sources import sheets, sinks, tables

SCORES = tables.SCHEMAS["scores"]
SHOOTERS = tables.SCHEMAS["shooters"]
ROUNDS = tables.SCHEMAS["rounds"]
USERS = "id BIGINT, email STRING, google_id STRING, name STRING, is_admin BOOLEAN, is_squad_leader BOOLEAN, team_approved BOOLEAN, team_id INT"


def rows(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=str)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def sheet(number=1, shooters=(), **header):
    return {"submission_id": number, "team_id": 1, "date": "2024-05-01", "shooters": list(shooters), **header}


def parsed(spark, *documents):
    return sheets.parse_sheets(spark.createDataFrame([(json.dumps(d),) for d in documents], "doc STRING"))


def split(spark, *documents):
    p = parsed(spark, *documents)
    return sheets.sheet_header_rows(p), ingest.judged_lines(sheets.sheet_line_rows(p))


def score(round_id, shooter_id, total, sub=None, stations=(None,) * 5):
    return (round_id, shooter_id, sub, *stations, total)


# --- expressions -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("total", "n", "places", "expected"),
    [(1, 20, 1, 0.1), (2675, 1000, 2, 2.68), (1005, 1000, 2, 1.01), (-1, 20, 1, -0.1), (7, 0, 1, None), (2, 3, 2, 0.67)],
)
def test_exact_avg(spark, total, n, places, expected):
    assert value(spark, exprs.exact_avg(F.lit(total), F.lit(n), places)) == expected


def test_trim_all_white_space(spark):
    assert value(spark, exprs.trimmed(F.lit("\t\u00a0\ufeff Al\u00a0B \u3000\n"))) == "Al\u00a0B"


@pytest.mark.parametrize(
    ("text", "expected"),
    [("16", 16.0), ("  ", 0.0), ("", 0.0), (" 0x10 ", 16.0), ("0b11", 3.0), ("0o17", 15.0), ("1e2", 100.0), (".5", 0.5),
     ("-3.", -3.0), ("Infinity", float("inf")), (None, None)],
)
def test_as_number(spark, text, expected):
    assert value(spark, exprs.as_number(exprs.trimmed(F.lit(text).cast("string")))) == expected


@pytest.mark.parametrize("text", ["abc", "1d", "1f", "NaN", "1 2", "0x", "inf", "1_0", "--1"])
def test_not_a_number(spark, text):
    number = exprs.as_number(exprs.trimmed(F.lit(text)))
    assert value(spark, F.isnan(number))
    assert value(spark, exprs.number_to_smallint(number)) is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [("20", 20), (" 20\t", 20), ("+5", 5), ("-5", -5), ("20.5", None), ("", None), ("32768", None), ("true", None)],
)
def test_text_to_smallint(spark, text, expected):
    assert value(spark, exprs.text_to_smallint(F.lit(text))) == expected


def test_numbers_come_back_from_words(spark):
    columns = [f"c{i}" for i in range(7)]
    given = [(k, *[(None, -32768, -1, 0, 1, 5, 32767)[(k + n * n) % 7] for n in range(7)]) for k in range(7)] + [(7, *[None] * 7), (8, *[32767] * 7)]
    frame = spark.createDataFrame(given, "k BIGINT, " + ", ".join(f"{c} SMALLINT" for c in columns))
    words = exprs.with_words(frame, columns)
    assert words.columns == ["k", "_w0", "_w1", "_w2"]
    found = exprs.without_words(words, columns)
    assert found.dtypes == frame.dtypes and rows(found) == rows(frame)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('{"a":1}', '{"a":1}'),
        ('```JSON\n{"a": 1}\n```', '{"a":1}'),
        ('I see {"a":"}"} ok', '{"a":"}"}'),
        ('{"a":1,"a":2}', '{"a":2}'),
        ('{"a":1} and {b}', None),
        ('{"a":1},"x":{}', None),
        ('{"a":1},{"b":2}', None),
        ('{"a":1}],[{}', None),
        ("{'a':1}", None),
        ('{"a":1,}', None),
        ('{"a":01}', None),
        ("} {", None),
        ("no json", None),
        (None, None),
    ],
)
def test_json_from_text(spark, text, expected):
    found = F.to_json(jsontext.strict_variant(jsontext.candidate(F.lit(text).cast("string"))))
    assert value(spark, found) == expected


def test_first_text_block(spark):
    blocks = F.from_json(
        F.lit('[{"type":"tool"},{"type":"text","text":"a"},{"type":"text","text":"b"}]'),
        "ARRAY<STRUCT<type STRING, text STRING>>",
    )
    assert value(spark, jsontext.first_text(blocks)) == "a"
    assert value(spark, jsontext.first_text(F.filter(blocks, lambda b: b["type"] == "tool"))) is None


# --- ingest ----------------------------------------------------------------------------


def test_text_stations_are_stored_but_not_summed(spark):
    _, judged = split(spark, sheet(shooters=[{"name": "Al", "stations": [5, "5", None, 2]}]))
    line = judged.first()
    assert (line.total, line.station_1, line.station_2, line.station_3, line.station_4, line.station_5) == (7, 5, 5, None, 2, None)
    assert line.counts and line.valid


def test_six_stations_summed_five_stored(spark):
    _, judged = split(spark, sheet(shooters=[{"name": "Al", "stations": [1, 2, 3, 4, 5, 5]}]))
    line = judged.first()
    assert (line.total, line.station_5) == (20, 5)


def test_given_total_wins(spark):
    _, judged = split(spark, sheet(shooters=[{"name": "Al", "stations": [1, 1, 1, 1, 1], "total": "9"}]))
    assert judged.first().total == 9


def test_bad_total_rejects_the_sheet_unless_the_line_is_skipped(spark):
    good = [{"name": "Al", "total": 20}, {"name": "Bo", "total": 21}]
    headers, judged = split(
        spark,
        sheet(1, [*good, {"name": "Cy", "total": 20.5}]),
        sheet(2, [*good, {"name": " ", "total": 20.5}]),
        sheet(3, [{"name": "Di", "stations": [99999, 0, 0, 0, 0], "total": 5}]),
        sheet(4, []),
        sheet(5, good, date="soon"),
    )
    reasons = dict(rows(ingest.sheet_verdicts(headers, judged), "submission_id", "reason"))
    assert reasons == {1: "line", 2: None, 3: "line", 4: "no_lines", 5: "date"}
    assert {r.submission_id for r in ingest.accepted_lines(headers, judged).collect()} == {2}


@pytest.mark.parametrize(
    ("yardage", "stored", "fault"),
    [("", None, None), (None, None, None), ("  ", 0, None), ("abc", None, "yardage"), (16, 16, None), ("16.5", None, "yardage"),
     (16.0, 16, None), (70000, None, "yardage")],
)
def test_yardage(spark, yardage, stored, fault):
    headers, _ = split(spark, sheet(yardage=yardage))
    typed = ingest.sheet_headers(headers).first()
    assert (typed.yardage, typed.fault, typed.round_number) == (stored, fault, 1)


def test_round_number_default_and_blank(spark):
    headers, _ = split(spark, sheet(1, roundNumber=""), sheet(2, roundNumber=" "), sheet(3, roundNumber="x"), sheet(4, roundNumber=3))
    typed = rows(ingest.sheet_headers(headers), "submission_id", "round_number", "fault")
    assert typed == [(1, 1, None), (2, 0, None), (3, None, "round_number"), (4, 3, None)]


def test_self_substitution_ignores_case_but_rosters_do_not(spark):
    _, judged = split(
        spark,
        sheet(shooters=[
            {"name": "al", "total": 1, "subFor": " AL "},
            {"name": "Al", "total": 2, "subFor": "Bo"},
            {"name": " Cy\t", "total": 3, "subFor": "  "},
        ]),
    )
    assert rows(judged, "name", "sub_for") == [("Al", "Bo"), ("Cy", None), ("al", None)]
    lines = ingest.storable_lines(judged).withColumn("team_id", F.lit(1))
    known = spark.createDataFrame([(7, 1, "Al"), (8, 2, "Bo")], SHOOTERS)
    roster = ingest.roster_upsert(lines, known)
    assert rows(roster.filter("NOT is_new"), "id", "team_id", "name") == [(7, 1, "Al"), (8, 2, "Bo")]
    fresh = roster.filter("is_new").collect()
    assert sorted(r.name for r in fresh) == ["Bo", "Cy", "al"]
    assert sorted(r.id for r in fresh) == [9, 10, 11]
    resolved = {r.name: r for r in ingest.resolve_names(lines, roster).collect()}
    ids = {(r.team_id, r.name): r.id for r in roster.collect()}
    assert resolved["Al"].sub_for_shooter_id == ids[(1, "Bo")] and resolved["Al"].shooter_id == 7
    assert resolved["Cy"].sub_for_shooter_id is None


def test_admins_may_name_another_team(spark):
    frame = spark.createDataFrame([(True, 2, 1), (False, 2, 1), (True, None, 1)], "is_admin BOOLEAN, asked INT, own INT")
    assert [r[0] for r in frame.select(ingest.effective_team("is_admin", "asked", "own")).collect()] == [2, 1, 1]


def test_edit_splits_by_lowest_number(spark):
    headers, judged = split(
        spark,
        sheet(5, [{"name": n, "total": 1, "roundNumber": r} for n, r in (("a", 3), ("b", 1), ("c", "1"))]),
        sheet(6, [{"name": "a", "total": 1}, {"name": " ", "total": 2, "roundNumber": 2}]),
        sheet(7, [], roundNumber=4),
        sheet(8, [{"name": " ", "roundNumber": "x"}]),
        sheet(9, [{"name": "a", "total": 1, "roundNumber": 2}], roundNumber="x"),
        sheet(10, [{"name": "a", "total": 1}], roundNumber="x"),
    )
    assert sorted(tuple(r) for r in ingest.split_rounds(headers, judged).collect()) == [
        (5, 1, True, 2, 2), (5, 3, False, 1, 1),
        (6, 1, True, 1, 1), (6, 2, False, 1, 0),
        (7, 4, True, 0, 0),
        (9, 2, True, 1, 1),
    ]


def test_numbers_and_teams_in_every_form(spark):
    docs = [
        '{"submission_id": 1, "team_id": "3", "date": "2024-05-01", "shooters": [{"name": "Al", "total": 2e1, "stations": [5e0, 4.0, "3"]}]}',
        '{"submission_id": 2, "team_id": " 3 ", "date": "2024-05-01", "shooters": [{"name": "Al", "total": "2e1"}]}',
        '{"submission_id": 3, "team_id": 3.0, "date": "2024-05-01", "shooters": [{"name": "Al", "total": 20.5}]}',
        '{"submission_id": 4, "team_id": "x", "date": "2024-05-01", "shooters": [{"name": "Al", "total": 2}]}',
        '{"submission_id": 5, "team_id": 0, "date": "2024-05-01", "shooters": [{"name": "Al", "total": 2}]}',
        "no sheet at all", '{"submission_id": 6,',
    ]
    p = sheets.parse_sheets(spark.createDataFrame([(d,) for d in docs], "doc STRING"))
    assert sorted(r[sheets.MALFORMED] for r in sheets.broken_sheets(p).collect()) == sorted(docs[5:])
    headers, judged = sheets.sheet_header_rows(p), ingest.judged_lines(sheets.sheet_line_rows(p))
    assert rows(headers, "submission_id", "team_id") == [(1, 3), (2, 3), (3, 3), (4, None), (5, None)]
    first = judged.filter("submission_id = 1").first()
    assert (first.total, first.station_1, first.station_2, first.station_3) == (20, 5, 4, 3)
    assert rows(ingest.rejected_submissions(headers, judged), "submission_id", "reason") == [
        (2, "line"), (3, "line"), (4, "team"), (5, "team")
    ]


def test_edit_replaces_moves_and_splits(spark):
    rounds = spark.sql(
        "SELECT * FROM VALUES (5L, 1, DATE'2024-01-01', 1S, 16S), (6L, 1, DATE'2024-01-02', 1S, 16S) "
        "AS t(id, team_id, round_date, round_number, yardage)"
    )
    shooters = spark.createDataFrame([(1, 1, "Al"), (2, 2, "Al")], SHOOTERS)
    scores = spark.createDataFrame([score(5, 1, 20), score(6, 1, 21)], SCORES)
    p = parsed(
        spark,
        sheet(5, [{"name": "Al", "total": 9, "subFor": "Bo"}, {"name": "Bo", "total": 8, "roundNumber": 2}], team_id=2),
        sheet(99, [{"name": "Al", "total": 1}]),
    )
    after, roster, rounds_after, refused = ingest.scores_after_edit(
        scores, shooters, rounds, sheets.sheet_header_rows(p), sheets.sheet_line_rows(p)
    )
    assert rows(refused) == [(99, "unknown_round")]
    ids = {(r.team_id, r.name): r.id for r in roster.collect()}
    new_round = next(r for r in rounds_after.collect() if r.source_id != r.id)
    assert (new_round.id, new_round.source_id, new_round.team_id, new_round.round_number) == (7, 5, 2, 2)
    assert rows(after, "round_id", "shooter_id", "sub_for_shooter_id", "total") == sorted(
        [(5, 2, ids[(2, "Bo")], 9), (7, ids[(2, "Bo")], None, 8), (6, 1, None, 21)], key=str
    )
    assert rounds_after.count() == 3


def test_edits_keep_their_team_or_are_reported(spark):
    rounds = spark.sql(
        "SELECT * FROM VALUES (5L, 1, DATE'2024-01-01', 1S, 16S), (6L, 2, DATE'2024-01-02', 1S, 16S), "
        "(7L, 2, DATE'2024-01-02', 1S, 16S), (8L, 2, DATE'2024-01-02', 1S, 16S), (9L, 2, DATE'2024-01-02', 1S, 16S) "
        "AS t(id, team_id, round_date, round_number, yardage)"
    )
    shooters = spark.createDataFrame([(1, 1, "Al")], SHOOTERS)
    scores = spark.createDataFrame([score(5, 1, 20)], SCORES)
    p = parsed(
        spark, sheet(5, [{"name": "Al", "total": 9}], team_id=None), sheet(6, [{"name": "Al", "total": 8}], team_id=0),
        sheet(7, [{"name": "Al", "total": 7}], team_id=44), sheet(8, [{"name": "Al", "total": "x"}]),
        sheet(9, [{"name": "Al", "total": 3}], date="soon"),
    )
    after, _, rounds_after, refused = ingest.scores_after_edit(
        scores, shooters, rounds, sheets.sheet_header_rows(p), sheets.sheet_line_rows(p), two_teams(spark)
    )
    assert rows(after, "round_id", "total") == [(5, 9), (6, 8)]
    assert rows(rounds_after, "id", "team_id") == [(5, 1), (6, 2), (7, 2), (8, 2), (9, 2)]
    assert rows(refused) == [(7, "unknown_team"), (8, "line"), (9, "date")]


def test_unknown_teams_reject_their_sheets(spark):
    headers, judged = split(spark, sheet(1, [{"name": "Al", "total": 1}]), sheet(2, [{"name": "Al", "total": 1}], team_id=44))
    found = ingest.rejected_submissions(ingest.with_known_teams(headers, two_teams(spark)), judged)
    assert rows(found, "submission_id", "reason") == [(2, "unknown_team")]


# --- reads -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def club(spark):
    shooters = spark.createDataFrame([(1, 1, "Al"), (2, 2, "Bo"), (3, 1, "Cy"), (4, 2, "Al")], SHOOTERS)
    rounds = spark.sql(
        "SELECT * FROM VALUES (10L, 1, DATE'2024-01-01', 1S, 16S), (11L, 1, DATE'2024-01-02', 2S, NULL), "
        "(12L, 1, DATE'2024-01-03', 1S, 20S) AS t(id, team_id, round_date, round_number, yardage)"
    )
    scores = spark.createDataFrame(
        [score(10, 1, 20), score(10, 2, 10, sub=1), score(11, 4, 25), score(11, 3, 5, sub=77), score(10, 88, 1)], SCORES
    )
    teams = spark.createDataFrame([(1, "One", None), (2, "Two", None)], tables.SCHEMAS["teams"])
    logos = spark.createDataFrame([(2, "data:image/png;base64,x")], tables.SCHEMAS["team_logos"])
    return {"scores": scores, "shooters": shooters, "rounds": rounds, "teams": teams, "logos": logos}


def test_leaderboard_rolls_up_and_survives_orphans(club):
    board = reads.team_leaderboard(club["scores"], club["shooters"], club["rounds"])
    assert rows(board, "team_id", "shooter_id", "name", "rounds", "subbed_rounds", "avg_total", "best_total") == [
        (1, 1, "Al", 2, 1, 15.0, 20),
        (1, 3, "Cy", 1, 1, 5.0, 5),  # an unknown subbed member falls back to who shot
        (1, 4, "Al", 1, 0, 25.0, 25),
    ]


def test_team_of_round_and_team_of_shooter_differ(club):
    top = reads.site_top_individuals(club["scores"], club["shooters"], club["teams"], club["logos"])
    assert [(r.id, r.team_id, r.team_logo) for r in top.collect()][0] == (4, 2, "data:image/png;base64,x")
    teams = reads.site_top_teams(club["scores"], club["rounds"], club["teams"], club["logos"])
    assert rows(teams, "id", "total_points", "rounds") == [(1, 61, 2)]


def test_namesakes_share_a_series_and_pages_continue(club):
    def series(**more):
        found = reads.shooter_trends(club["scores"], club["shooters"], club["rounds"], **more).collect()
        return {(r.name, r.page): json.loads(r.history) for r in found}

    whole = series()
    assert whole[("Al", 0)] == [{"date": "2024-01-01", "total": 20}, {"date": "2024-01-02", "total": 25}]
    for heavy_rows in (1_000_000, 1):
        paged = series(page_rows=1, heavy_rows=heavy_rows)
        assert paged[("Al", 0)] + paged[("Al", 1)] == whole[("Al", 0)]


def test_history_keeps_rounds_without_scores(club):
    found = reads.round_history(club["scores"], club["shooters"], club["rounds"], team_id=1).collect()
    assert [r.id for r in found] == [12, 11, 10]
    assert found[0].shooters == "[]"
    assert json.loads(found[2].shooters) == [
        {"name": "Al", "stations": [None] * 5, "total": 20, "subFor": None},
        {"name": "Bo", "stations": [None] * 5, "total": 10, "subFor": "Al"},
    ]


def test_one_round_is_listed_by_name(club):
    found = reads.round_detail(club["scores"], club["shooters"], club["rounds"], club["teams"], round_id=10).collect()
    assert [(r.name, r.team_name, r.sub_for_name) for r in found] == [("Al", "One", None), ("Bo", "One", "Al")]


def test_own_league_comes_first(spark):
    leagues = spark.createDataFrame([(1, "B"), (2, "C"), (3, "A")], "id INT, name STRING")
    teams = spark.createDataFrame([(1, 2), (2, 2), (3, None), (4, 9)], "id INT, league_id INT")
    lists = {}
    for r in derived.league_lists(leagues, teams).orderBy("place").collect():
        lists.setdefault(r.own_league_id, []).append(r.league_id)
    assert lists == {2: [2, 3, 1], None: [3, 1, 2], 9: [3, 1, 2]}


def test_documents_round_trip(spark, club, tmp_path):
    history = reads.round_history(club["scores"], club["shooters"], club["rounds"])
    sinks.write_documents(history, str(tmp_path / "history"))
    assert spark.read.json(str(tmp_path / "history")).count() == 3


# --- members -----------------------------------------------------------------------------


def user(number, team=None, approved=True, admin=False, leader=False, name=None, google=None):
    return (number, f"u{number}@x", google, name, admin, leader, approved, team)


def test_admins_are_asked_only_without_leaders(spark):
    users = spark.createDataFrame(
        [user(1, 1, leader=True), user(2, 1, admin=True), user(3, 2, admin=True), user(4, 1, approved=False, name="Al"),
         user(5, 2, approved=False), user(6, 3, approved=False)],
        USERS,
    )
    teams = spark.createDataFrame([(1, "One", None), (2, "Two", None), (3, "Three", None)], tables.SCHEMAS["teams"])
    assert rows(directory.notification_recipients(users)) == [(1, 1, "u1@x"), (2, 2, "u3@x")]
    assert rows(directory.pending_notifications(users, teams), "user_id", "subject", "recipients") == [
        (4, "Al (u4@x) wants to join One", 1), (5, "u5@x wants to join Two", 1),
    ]


REQUESTS = "seq INT, user_id BIGINT, action STRING, team_id INT, team_name STRING"


def two_teams(spark):
    return spark.createDataFrame([(1, "One", None), (2, "Two", None)], tables.SCHEMAS["teams"])


def test_requests(spark):
    users = spark.createDataFrame(
        [user(1), user(2, admin=True), user(3), user(4, 1), user(5, 1, approved=False), user(6, 2), user(7, 1, leader=True)], USERS
    )
    asked = spark.createDataFrame(
        [(1, 1, "create", None, " New "), (2, 1, "join", 1, None), (3, 2, "join", 1, None), (4, 3, "create", 2, "One"),
         (5, 4, "deny", 1, None), (6, 5, "approve", 1, None), (7, 6, "deny", 1, None), (8, 7, "join", 2, None),
         (9, 4, "join", 999, None), (10, 4, "join", 0, " "), (11, 4, "create", 2, " "), (12, 4, "approve", 2, None),
         (13, 99, "join", 1, None), (14, 3, "deny", 1, None), (15, 7, "join", 999, None), (16, 6, "approve", None, None)],
        REQUESTS,
    )
    for width in (2, 4096):
        after, outcomes, teams = membership.apply_requests(users, asked, two_teams(spark), width)
        assert sorted(map(tuple, outcomes.select("seq", "outcome").collect())) == [
            (1, "created"), (2, "already_on_a_team"), (3, "joined"), (4, "created"), (5, "denied"), (6, "approved"),
            (7, "other_team"), (8, "already_on_a_team"), (9, "unknown_team"), (10, "no_team_given"), (11, "pending"),
            (12, "approved"), (13, "unknown_user"), (14, "denied"), (15, "already_on_a_team"), (16, "other_team"),
        ]
        assert rows(teams, "id", "name") == [(1, "One"), (2, "Two"), (3, "New")]
        assert after.columns == users.columns
        assert rows(after, "id", "team_id", "team_approved", "is_squad_leader") == [
            (1, 3, True, True), (2, 1, True, False), (3, None, True, True), (4, 2, True, False), (5, 1, True, False),
            (6, 2, True, False), (7, 1, True, True),
        ]


def test_requests_of_one_busy_member(spark):
    """A third of all requests come from one member; the order decides throughout."""
    draw = random.Random(5)
    users = [user(k, draw.choice([None, 1, 2]), admin=k % 4 == 0) for k in range(1, 9)]
    asked = [
        (seq, 1 if seq % 3 == 0 else draw.randint(1, 8), draw.choice(["join", "create", "approve", "deny", "deny"]),
         draw.choice([1, 2, 2, 999]), draw.choice([None, None, "One", "Fresh"]))
        for seq in draw.sample(range(5_000), 900)
    ]
    state = {u[0]: [u[7], u[6], u[5]] for u in users}
    names = {1: "One", 2: "Two"}
    want = []
    for seq, member, action, team, name in sorted(asked):
        on, _, leader = state[member]
        if action in ("join", "create"):
            if on:
                outcome = "already_on_a_team"
            elif name:
                outcome, state[member] = "created", [name, True, True]
            elif team not in names:
                outcome = "unknown_team"
            else:
                admin = member % 4 == 0
                outcome, state[member] = "joined" if admin else "pending", [team, admin, leader]
        elif on is None or names.get(on, on) != names.get(team):
            outcome = "other_team"
        elif action == "approve":
            outcome, state[member] = "approved", [on, True, leader]
        else:
            outcome, state[member] = "denied", [None, True, leader]
        want.append((seq, outcome))
    frame = spark.createDataFrame(asked, REQUESTS)
    for width in (3, 64, 4096):
        after, outcomes, teams = membership.apply_requests(spark.createDataFrame(users, USERS), frame, two_teams(spark), width)
        assert sorted(map(tuple, outcomes.select("seq", "outcome").collect())) == want
        named = {r["id"]: r["name"] for r in teams.collect()}
        got = {r["id"]: [named.get(r["team_id"]), r["team_approved"], r["is_squad_leader"]] for r in after.collect()}
        assert got == {k: [names.get(t, t), a, x] for k, (t, a, x) in state.items()}


def test_a_member_with_denials_of_many_teams(spark):
    """No Python, and every row of every table written on the way holds one request."""
    teams = spark.range(1, 901).selectExpr("CAST(id AS INT) AS id", "concat('T', id) AS name", "CAST(NULL AS INT) AS league_id")
    asked = spark.range(6_000).selectExpr(
        "CAST(id AS INT) AS seq", "1L AS user_id", "IF(id % 2 = 0, 'deny', 'join') AS action",
        "CAST(IF(id % 2 = 0, (id * 7) % 900, id % 900) + 1 AS INT) AS team_id", "CAST(NULL AS STRING) AS team_name",
    )
    users = spark.createDataFrame([user(1)], USERS)
    on, want = None, {}
    for seq in range(6_000):
        team = ((seq * 7) % 900 if seq % 2 == 0 else seq % 900) + 1
        if seq % 2:
            want[seq] = "already_on_a_team" if on else "pending"
            on = on or team
        else:
            want[seq] = "denied" if on == team else "other_team"
            on = None if on == team else on
    after, outcomes, _ = membership.apply_requests(users, asked, teams, 512)
    assert {r["seq"]: r["outcome"] for r in outcomes.collect()} == want
    assert after.first()["team_id"] == on
    for frame in (after, outcomes):
        assert not re.search("Python|Arrow", frame._jdf.queryExecution().executedPlan().toString())
        assert not any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in frame.schema)


def test_events_before_and_after(spark):
    draw = random.Random(2)
    held = [(draw.choice("ab"), pos, draw.choice([None, None, pos])) for pos in draw.sample(range(400), 120)]
    frame = spark.createDataFrame(held, "k STRING, pos BIGINT, mark BIGINT")
    for width in (1, 7, 1000):
        found = skew.event_before(skew.event_after(frame, ["k"], F.col("mark"), "later", width), ["k"], F.col("mark"), "earlier", width)
        for r in found.collect():
            marks = [m for k, _, m in held if k == r["k"] and m is not None]
            assert r["later"] == min((m for m in marks if m > r["pos"]), default=None)
            assert r["earlier"] == max((m for m in marks if m < r["pos"]), default=None)
        assert found.count() == len(held)


def test_sheets_go_to_the_team_of_their_sender(spark):
    users = spark.createDataFrame([user(1, 1, admin=True), user(2, 2), user(3), user(4, admin=True)], USERS)
    headers = spark.createDataFrame(
        [(1, 1, 5), (2, 1, None), (3, 1, 0), (4, 2, 5), (5, 2, None), (6, 3, 5), (7, 4, 5), (8, 4, None), (9, 77, 5), (10, None, 5)],
        "submission_id BIGINT, user_id BIGINT, team_id INT",
    ).selectExpr("*", "'2024-01-01' AS raw_date", "CAST(NULL AS STRING) AS raw_yardage", "CAST(NULL AS STRING) AS raw_round_number")
    found = ingest.with_submitters(headers, users)
    assert rows(found, "submission_id", "team_id", "known_sender") == [
        (1, 5, True), (10, 5, True), (2, 1, True), (3, 1, True), (4, 2, True), (5, 2, True), (6, None, True), (7, 5, True),
        (8, None, True), (9, None, False),
    ]
    lines = headers.selectExpr("submission_id", "true AS counts", "true AS valid")
    assert rows(ingest.sheet_verdicts(found, lines).filter("reason IS NOT NULL"), "submission_id", "reason") == [
        (6, "team"), (8, "team"), (9, "unknown_sender"),
    ]


APPLICANTS = "seq INT, raw_email STRING, team_id INT, new_team_name STRING"


def test_first_account_on_an_empty_site(spark):
    nobody = spark.createDataFrame([], USERS)
    teams = spark.createDataFrame([(1, "One", None)], tables.SCHEMAS["teams"])
    asked = spark.createDataFrame(
        [(1, "nope", None, None), (2, " A@x ", 1, None), (3, "b@x", 1, None), (4, "a@X", None, None), (5, "c@x", 1, " One ")], APPLICANTS
    )
    made = maintain.account_intake(asked, nobody, teams)
    assert rows(made, "seq", "outcome", "is_admin", "team_approved", "is_squad_leader", "names_existing_team") == [
        (1, "invalid_email", None, None, None, None),
        (2, "created", True, True, False, False),
        (3, "created", False, False, False, False),
        (4, "email_taken", None, None, None, None),
        (5, "created", False, True, True, True),
    ]
    closed = maintain.account_intake(asked, nobody, teams, registration_open=False)
    assert dict(rows(closed, "seq", "outcome")) == {
        1: "invalid_email", 2: "created", 3: "registration_closed", 4: "registration_closed", 5: "registration_closed"
    }


def test_accounts_and_teams_after_intake(spark):
    users = spark.createDataFrame([user(7, 1)], USERS)
    asked = spark.createDataFrame(
        [(1, "a@x", 77, None, "A"), (2, "A@x ", 1, None, " Ann "), (3, "a@x", 1, None, "late"), (4, "b@x", 0, None, " "),
         (5, "c@x", 77, " New ", None), (6, "d@x", None, "One", None), (7, "u7@x", 77, None, None)],
        APPLICANTS + ", raw_name STRING",
    )
    intake = maintain.account_intake(asked, users, two_teams(spark))
    assert dict(rows(intake, "seq", "outcome")) == {
        1: "unknown_team", 2: "created", 3: "email_taken", 4: "created", 5: "created", 6: "created", 7: "email_taken"
    }
    after, teams = maintain.users_after_intake(intake, users, two_teams(spark))
    assert rows(teams, "id", "name") == [(1, "One"), (2, "Two"), (3, "New")]
    got = {r["email"]: r for r in after.collect()}
    assert sorted(r["id"] for r in got.values()) == [7, 8, 9, 10, 11]
    assert {e: (r["name"], r["team_id"], r["is_squad_leader"], r["team_approved"], r["is_admin"]) for e, r in got.items() if e != "u7@x"} == {
        "a@x": ("Ann", 1, False, False, False), "b@x": (None, None, False, True, False), "c@x": (None, 3, True, True, False),
        "d@x": (None, 1, True, True, False),
    }


SIGN_INS = "seq INT, external_id STRING, raw_email STRING, email_verified BOOLEAN"


def test_identities_match_in_tiers(spark):
    users = spark.createDataFrame([user(1, google="g1"), user(2)], USERS)
    seen = spark.createDataFrame(
        [(1, "g1", "other@x", True), (2, "g2", " U2@X ", True), (3, "g3", "new@x", True), (4, "g4", "u2@x", False),
         (5, "g3", "new@x", True), (6, "g6", "new@x", True)],
        SIGN_INS,
    )
    assert rows(maintain.identity_match(seen, users), "seq", "user_id", "outcome") == [
        (1, 1, "signed_in"), (2, 2, "linked"), (3, None, "created"), (4, None, "rejected"),
        (5, None, "signed_in"), (6, None, "linked"),
    ]


def test_an_account_holds_one_outside_id(spark, monkeypatch):
    """Each sign-in meets what those before it left; compared with one step after the other."""
    draw = random.Random(3)
    emails = {f"g{k}": f"u{draw.randint(1, 6)}@x" for k in range(12)}
    users = [user(1, google="g0"), user(2, google="g1"), user(3, google="old"), user(4)]
    emails["g0"], emails["g1"] = "u1@x", "u5@x"
    asked = [(seq, g, emails[g], draw.random() < 0.9) for seq, g in enumerate(draw.choices(sorted(emails), k=200))]
    frame = spark.createDataFrame(asked, SIGN_INS)
    stored = spark.createDataFrame(users, USERS)
    for width in (7, 65_536):
        monkeypatch.setattr(maintain, "SIGN_INS", width)
        for is_open in (True, False):
            held = {u[1]: u[2] for u in users}
            want = []
            for seq, g, e, ok in asked:
                if not ok:
                    want.append((seq, "rejected"))
                elif g in held.values():
                    want.append((seq, "signed_in"))
                elif e in held:
                    held[e] = g
                    want.append((seq, "linked"))
                elif is_open:
                    held[e] = g
                    want.append((seq, "created"))
                else:
                    want.append((seq, "registration_closed"))
            matched = maintain.identity_match(frame, stored, registration_open=is_open)
            assert sorted(map(tuple, matched.select("seq", "outcome").collect())) == want
            after = maintain.users_after_sign_in(matched, frame.withColumn("raw_name", F.lit(" N ")), stored)
            assert {r["email"]: r["google_id"] for r in after.collect()} == held
            assert {r["name"] for r in after.collect() if r["id"] > 4} <= {"N"}


# --- maintenance ---------------------------------------------------------------------------


def test_delete_shooter_clears_references(spark):
    scores = spark.createDataFrame([score(1, 1, 9, sub=2), score(1, 2, 8), score(1, 3, 7)], SCORES)
    left = maintain.without_shooters(scores, spark.createDataFrame([(2,)], "id BIGINT"))
    assert rows(left, "shooter_id", "sub_for_shooter_id", "total") == [(1, None, 9), (3, None, 7)]


def test_team_with_members_stays(spark, club):
    members = spark.createDataFrame([user(1, 1)], USERS)
    wanted = spark.createDataFrame([(1,), (2,), (9,)], "id INT")
    after = maintain.delete_teams(wanted, club["teams"], club["shooters"], club["rounds"], club["scores"], members)
    assert rows(after["teams"], "id") == [(1,)]
    assert rows(after["shooters"], "id") == [(1,), (3,)]
    assert after["rounds"].count() == 3
    assert rows(maintain.team_delete_report(wanted, club["teams"], members), "id", "outcome") == [
        (1, "has_members"), (2, "deleted"), (9, "not_found")
    ]


def test_members_delete_only_their_own_rounds_and_never_themselves(spark, club):
    wanted = spark.createDataFrame([(10,), (99,)], "id BIGINT")
    assert rows(maintain.own_rounds(wanted, club["rounds"], 1)) == [(10,)]
    assert rows(maintain.own_rounds(wanted, club["rounds"], 2)) == []
    users = spark.createDataFrame([user(1, admin=True), user(2)], USERS)
    asked = spark.createDataFrame([(1, 1), (2, 1)], "id BIGINT, requested_by BIGINT")
    assert rows(maintain.without_users(users, asked), "id") == [(1,)]


def test_team_patches(spark):
    teams = spark.createDataFrame([(1, "A", 5), (2, "B", 5), (3, "C", 5), (4, "D", 5), (5, "E", 5)], "id INT, name STRING, league_id INT")
    patch = spark.createDataFrame(
        [(1, " A2 ", None, False), (2, "C", None, True), (3, "C", 0, True), (4, " ", 6, True), (9, "Z", None, False),
         (5, "E2", 77, True)],
        "id INT, name STRING, league_id INT, league_id_set BOOLEAN",
    )
    after, report = maintain.patch_teams(teams, patch, spark.createDataFrame([(5,)], "id INT"))
    assert rows(after) == [(1, "A2", 5), (2, "B", 5), (3, "C", None), (4, "D", 5), (5, "E", 5)]
    assert dict(rows(report, "id", "outcome")) == {
        1: "updated", 2: "conflict", 3: "updated", 4: "name_required", 5: "unknown_league", 9: "not_found"
    }


def test_shooter_patches(spark):
    shooters = spark.createDataFrame([(1, 1, "Al"), (2, 2, "Al"), (3, 1, "Cy"), (4, 1, "Ed")], SHOOTERS)
    patch = spark.createDataFrame([(1, None, 2), (2, " Di ", None), (3, " ", None), (8, "X", 1), (4, "Ed", 77)], "id BIGINT, name STRING, team_id INT")
    after, report = maintain.patch_shooters(shooters, patch, two_teams(spark))
    assert rows(after) == [(1, 1, "Al"), (2, 2, "Di"), (3, 1, "Cy"), (4, 1, "Ed")]
    assert dict(rows(report)) == {1: "conflict", 2: "updated", 3: "nothing_to_update", 4: "unknown_team", 8: "not_found"}


def test_logo_patches(spark):
    logos = spark.createDataFrame([(1, "data:image/a"), (2, "data:image/b"), (3, "data:image/c")], tables.SCHEMAS["team_logos"])
    asked = spark.createDataFrame(
        [(1, 1, None, True, False, None), (2, 2, "data:image/y", False, True, 2), (3, 2, "data:image/z", False, True, 2),
         (4, 3, "x", True, False, None), (5, 4, "data:image/q", False, True, 2), (6, 3, "", True, False, None),
         (7, 77, "data:image/q", True, False, None)],
        "seq INT, team_id INT, logo_data STRING, is_admin BOOLEAN, is_squad_leader BOOLEAN, own_team_id INT",
    )
    after, report = maintain.patch_logos(logos, asked, spark.range(1, 5).select(F.col('id').cast('int').alias('id')))
    assert rows(after) == [(2, "data:image/z"), (3, "data:image/c")]
    assert dict(rows(report, "seq", "outcome")) == {
        1: "cleared", 2: "set", 3: "set", 4: "not_an_image", 5: "forbidden", 6: "not_an_image",
        7: "not_found",
    }


def test_user_patch_keeps_what_was_not_supplied(spark):
    users = spark.createDataFrame([user(1, 1, leader=True), user(2, 1), user(3, 1)], USERS)
    patch = spark.createDataFrame(
        [(1, True, True, None, True, None, False, 0, True), (2, True, True, None, False, None, False, 77, True),
         (3, None, True, None, None, None, False, None, False), (9, True, True, None, False, None, False, None, False)],
        "id BIGINT, is_admin BOOLEAN, is_admin_set BOOLEAN, is_squad_leader BOOLEAN, is_squad_leader_set BOOLEAN, "
        "team_approved BOOLEAN, team_approved_set BOOLEAN, team_id INT, team_id_set BOOLEAN",
    )
    after, report = maintain.patch_users(users, patch, two_teams(spark))
    assert rows(after, "id", "is_admin", "is_squad_leader", "team_approved", "team_id") == [
        (1, True, True, True, None), (2, False, False, True, 1), (3, False, False, True, 1)
    ]
    assert dict(rows(report)) == {1: "updated", 2: "unknown_team", 3: "nothing_to_update", 9: "not_found"}


def test_inserted_shooters_get_ids(spark):
    shooters = spark.createDataFrame([(4, 1, "Al")], SHOOTERS)
    asked = spark.createDataFrame(
        [(1, " Al ", 1, 1), (1, "Bo", 1, 2), (1, "Bo", 1, 3), (77, "Cy", 1, 4), (0, "Di", 1, 5), (None, "Di", 1, 6), (2, " ", 1, 7)],
        "team_id INT, raw_name STRING, submission_id BIGINT, pos INT",
    )
    after, report = maintain.insert_shooters(asked, shooters, two_teams(spark))
    assert rows(after) == [(4, 1, "Al"), (5, 1, "Bo")]
    assert rows(report, "team_id", "name", "outcome", "conflicts") == sorted(
        [(1, "Al", "conflict", 1), (1, "Bo", "inserted", 1), (77, "Cy", "unknown_team", 0), (0, "Di", "invalid", 0),
         (None, "Di", "invalid", 0), (2, "", "invalid", 0)], key=str,
    )


def test_sheet_team_overrides(spark):
    frame = spark.createDataFrame([(True, 0, 5), (True, 3, 5), (True, None, 5), (False, 3, 5)], "admin BOOLEAN, asked INT, own INT")
    got = frame.select(ingest.effective_team("admin", "asked", "own").alias("t"))
    assert [r.t for r in got.collect()] == [5, 3, 5, 5]


def test_leagues(spark):
    leagues = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "id INT, name STRING, location STRING")
    values = spark.createDataFrame([(1, " A2 ", "  ", " mail "), (2, "A", "z", None)], "id INT, name STRING, location STRING, contact_email STRING")
    after = maintain.replace_leagues(leagues, values)
    assert rows(after, "id", "name", "location", "contact_email") == [(1, "A2", None, "mail"), (2, "B", "y", None)]
    asked = spark.createDataFrame([(1, "B", "q"), (2, " N ", " q "), (3, "N", "r"), (4, " ", "s")], "seq INT, name STRING, location STRING")
    added, report = maintain.insert_leagues(asked, leagues)
    assert rows(added) == [(1, "A", "x"), (2, "B", "y"), (3, "N", "q")]
    assert dict(rows(report, "seq", "outcome")) == {1: "conflict", 2: "inserted", 3: "conflict", 4: "name_required"}


def test_default_team_and_upgrades(spark):
    teams = spark.createDataFrame([(3, "A", 1)], "id INT, name STRING, league_id INT")
    once = maintain.with_default_team(teams)
    assert rows(maintain.with_default_team(once)) == [(3, "A", 1), (4, "Default Team", None)]
    assert rows(maintain.upsert_teams(spark.createDataFrame([(" A ",), ("B",), ("B",), (" ",)], "name STRING"), teams)) == [
        (3, "A", 1), (4, "B", None)
    ]
    old = spark.createDataFrame([(1,)], "id BIGINT")
    assert maintain.upgrade(old, "users").first().team_approved is True
    assert maintain.upgrade(old, "rounds").first().round_number == 1


def test_constraints_are_counted(spark, club):
    users = spark.createDataFrame([user(1, 1), user(1, 7)], USERS).withColumn("created_at", F.current_timestamp())
    leagues = spark.createDataFrame([(1, None)], "id INT, name STRING")
    found = maintain.constraint_violations({**club, "users": users, "leagues": leagues}, club["logos"])
    assert rows(found.filter("violations > 0")) == sorted(
        [("leagues", "not null name", 1), ("scores", "shooter_id in shooters", 1), ("scores", "sub_for_shooter_id in shooters", 1),
         ("users", "team_id in teams", 1), ("users", "unique email", 1), ("users", "unique id", 1)],
        key=str,
    )
