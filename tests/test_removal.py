"""Requested deletes against the same requests one by one."""

import random

import pytest

from tallyline.operators import removal
from tallyline.sources import tables

REQUESTS = "seq BIGINT, kind STRING, id BIGINT, requested_by BIGINT"


def one_by_one(requests, users, teams, rounds, shooters, leagues):
    """Outcomes and what is left, by applying each request to the tables."""
    rights = {u: (admin, team) for u, admin, team in users}
    left = {
        "user": {u: t for u, _, t in users}, "team": {t: t for t in teams}, "round": dict(rounds), "shooter": dict(shooters),
        "league": {k: None for k in leagues},
    }
    out = []
    for seq, kind, key, by in sorted(requests):
        admin, own = rights.get(by, (False, None))
        held = left.get(kind)
        first = {"round": dict(rounds)}.get(kind, {})
        if held is None:
            outcome = "unknown_kind"
        elif kind == "round" and key not in first:
            outcome = "not_found"
        elif not admin and not (kind == "round" and own is not None and first[key] == own):
            outcome = "forbidden"
        elif kind == "user" and key == by and key in rights:
            outcome = "own_account"
        elif key not in held:
            outcome = "not_found"
        elif kind == "team" and key in left["user"].values():
            outcome = "has_members"
        else:
            outcome = "deleted"
            del held[key]
            if kind == "team":
                for part in ("round", "shooter"):
                    left[part] = {k: t for k, t in left[part].items() if t != key}
        out.append((seq, outcome))
    return out, {k: set(v) for k, v in left.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_requests_follow_their_order(spark, seed):
    draw = random.Random(seed)
    users = [(k, k % 4 == 0, draw.choice([None, 1, 2, 3])) for k in range(1, 13)]
    teams, leagues = [1, 2, 3, 4], [1, 2]
    rounds = [(k, draw.choice([1, 2, 3, 4])) for k in range(20)]
    shooters = [(k, draw.choice([1, 2, 3, 4])) for k in range(10)]
    kinds = ["round", "round", "shooter", "team", "team", "user", "user", "user", "league", "dog", None]
    asked = [(seq, draw.choice(kinds), draw.randint(1, 14), draw.choice([4, 8, 12, 4, 8, draw.randint(1, 14), None])) for seq in draw.sample(range(1000), 260)]
    frame = lambda rows, names, table: spark.createDataFrame(rows, names).to(spark.createDataFrame([], tables.SCHEMAS[table]).schema)
    club = {
        "users": frame(users, "id BIGINT, is_admin BOOLEAN, team_id INT", "users"),
        "teams": frame([(t, f"T{t}", 1 + t % 2) for t in teams], "id INT, name STRING, league_id INT", "teams"),
        "rounds": frame(rounds, "id BIGINT, team_id INT", "rounds"), "shooters": frame(shooters, "id BIGINT, team_id INT", "shooters"),
        "leagues": frame([(k, f"L{k}") for k in leagues], "id INT, name STRING", "leagues"),
        "scores": frame([(r, s, (r + s) % 10) for r, _ in rounds for s in range(10)], "round_id BIGINT, shooter_id BIGINT, sub_for_shooter_id BIGINT", "scores"),
    }
    want, left = one_by_one([a for a in asked], users, teams, rounds, shooters, leagues)
    requests = spark.createDataFrame(asked, REQUESTS)
    report = removal.delete_report(requests, club)
    assert sorted((r["seq"], r["outcome"]) for r in report.collect()) == want
    assert {"deleted", "forbidden", "not_found", "has_members", "own_account", "unknown_kind"} >= {o for _, o in want}
    after = removal.after_deletes(report, club)
    for kind, table in removal.KINDS.items():
        assert {r["id"] for r in after[table].collect()} == left[kind], kind
    assert {r["league_id"] for r in after["teams"].collect()} <= left["league"] | {None}
    scores = after["scores"].collect()
    assert {(r["round_id"], r["shooter_id"]) for r in scores} == {(a, b) for a in left["round"] for b in left["shooter"]}
    assert all(r["sub_for_shooter_id"] == ((r["round_id"] + r["shooter_id"]) % 10 if (r["round_id"] + r["shooter_id"]) % 10 in left["shooter"] else None) for r in scores)


def test_a_team_goes_after_its_last_member(spark):
    users = spark.createDataFrame([(1, True, None), (2, False, 5)], "id BIGINT, is_admin BOOLEAN, team_id INT")
    none = {t: spark.createDataFrame([], tables.SCHEMAS[t]) for t in ("rounds", "shooters", "leagues", "scores")}
    club = {**none, "users": users, "teams": spark.createDataFrame([(5, "A", None)], tables.SCHEMAS["teams"])}
    asked = [(1, "team", 5, 1), (2, "user", 2, 1), (3, "team", 5, 1), (4, "team", 5, 1), (5, "user", 1, 1), (6, "team", 5, 2)]
    report = removal.delete_report(spark.createDataFrame(asked, REQUESTS), club)
    assert [r["outcome"] for r in report.orderBy("seq").collect()] == ["has_members", "deleted", "deleted", "not_found", "own_account", "forbidden"]
    assert removal.delete_report(spark.createDataFrame([], REQUESTS), club).count() == 0
