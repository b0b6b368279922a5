"""The same results as the catalog in plain SQL, for side-by-side checks."""

from __future__ import annotations

from tallyline.sources.fixtures import BASE_TABLES, BLOCKS, NEEDS

ORACLES: dict[str, str] = {}


def with_views(views: str, body: str) -> str:
    """Prefix ``body`` with the score-table views it names, each after those it reads."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS[name]:
            if needed not in BASE_TABLES:
                visit(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views.split():
        visit(view)
    plain = {name: name for name in (*BASE_TABLES, *BLOCKS)}
    ctes = [f"{name} AS ({BLOCKS[name].format(**plain)})" for name in ordered]
    body = body.strip()
    if body.startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE"):]
    if body.startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[len("WITH"):]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def oracle(name: str, views: str, body: str) -> None:
    ORACLES[name] = with_views(views, body)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def avg(total: str, n: str, places: int) -> str:
    """Exact rounded average of non-negative integers."""
    scale = 10**places
    return f"CAST((2*{scale}*{total}+{n}) // (2*{n}) AS DOUBLE)/{scale}"


STATIONS = [f"station_{i}" for i in range(1, 6)]
ST = ", ".join(STATIONS)

# --- leaderboards, trends, histories -------------------------------------------

def _leaderboard(teams: str) -> str:
    return f"""
SELECT r.team_id, CAST(COALESCE(b.id, a.id) AS BIGINT) AS shooter_id, COALESCE(b.name, a.name) AS name,
       count(*) AS rounds, count(s.sub_for_shooter_id) AS subbed_rounds,
       {avg("sum(s.total)", "count(*)", 1)} AS avg_total, CAST(max(s.total) AS INT) AS best_total,
       {", ".join(avg(f"sum({c})", f"count({c})", 2) + f" AS avg_{c}" for c in STATIONS)}
FROM scores s JOIN rounds r ON s.round_id = r.id JOIN shooters a ON s.shooter_id = a.id
LEFT JOIN shooters b ON s.sub_for_shooter_id = b.id
WHERE {teams} GROUP BY 1, 2, 3"""


oracle("team_leaderboard", "scores shooters rounds", _leaderboard("true"))
oracle("stored_leaderboard", "scores shooters rounds", _leaderboard("true"))
oracle("stored_team_leaderboard", "scores shooters rounds", _leaderboard("r.team_id = 3"))

oracle("month_trends", "scores rounds", f"""
SELECT strftime(r.round_date, '%Y-%m-%d') AS date, {avg("sum(s.total)", "count(*)", 1)} AS avg
FROM scores s JOIN rounds r ON s.round_id = r.id
WHERE r.round_date BETWEEN DATE '1995-03-01' AND DATE '1995-03-31' GROUP BY r.round_date""")

oracle("replaced_year", "scores rounds", """
SELECT r.id, r.team_id, strftime(r.round_date, '%Y-%m-%d') AS round_date, r.round_number,
       CASE WHEN year(r.round_date) = 1995 THEN CAST(27 AS SMALLINT) ELSE r.yardage END AS yardage,
       count(s.round_id) AS n_scores
FROM rounds r LEFT JOIN scores s ON s.round_id = r.id
WHERE year(r.round_date) <> 1995 OR r.id % 2 = 0 GROUP BY ALL""")

_POINTS = """
points AS (SELECT r.team_id, a.name, r.round_date, r.round_number, s.round_id, s.total
           FROM scores s JOIN rounds r ON s.round_id = r.id JOIN shooters a ON s.shooter_id = a.id)"""

oracle("shooter_trend_points", "scores shooters rounds", f"""WITH {_POINTS}
SELECT team_id, name, strftime(round_date, '%Y-%m-%d') AS round_date, round_number, round_id, total FROM points""")

oracle("shooter_trends", "scores shooters rounds", f"""WITH {_POINTS},
paged AS (SELECT *, row_number() OVER w AS seq FROM points
          WINDOW w AS (PARTITION BY team_id, name ORDER BY round_date, round_number, round_id, total))
SELECT team_id, name, CAST((seq - 1) // 10000 AS INT) AS page,
       CAST(to_json(list({{'date': strftime(round_date, '%Y-%m-%d'), 'total': total}} ORDER BY seq)) AS VARCHAR) AS history
FROM paged GROUP BY 1, 2, 3""")

_BY_SHOOTER = """
by_shooter AS (SELECT a.id, a.name, t.id AS team_id, t.name AS team_name,
                      CAST(sum(s.total) AS BIGINT) AS total_points, count(*) AS rounds
               FROM scores s JOIN shooters a ON s.shooter_id = a.id JOIN teams t ON a.team_id = t.id
               GROUP BY 1, 2, 3, 4)"""
_BY_TEAM = """
by_team AS (SELECT t.id, t.name, CAST(sum(s.total) AS BIGINT) AS total_points, count(DISTINCT r.id) AS rounds
            FROM scores s JOIN rounds r ON s.round_id = r.id JOIN teams t ON r.team_id = t.id
            GROUP BY 1, 2)"""

oracle("site_top_individuals", "scores shooters teams team_logos", f"""WITH {_BY_SHOOTER}
SELECT b.id, b.name, b.team_id, team_name, logo_data AS team_logo, total_points, rounds
FROM (SELECT * FROM by_shooter ORDER BY total_points DESC, id LIMIT 10) b LEFT JOIN team_logos l USING (team_id)""")

oracle("site_top_teams", "scores rounds teams team_logos", f"""WITH {_BY_TEAM}
SELECT b.id, b.name, logo_data AS logo, total_points, rounds
FROM (SELECT * FROM by_team ORDER BY total_points DESC, id LIMIT 10) b LEFT JOIN team_logos l ON l.team_id = b.id""")

oracle("leader_callouts", "scores shooters rounds teams team_logos", f"""WITH {_BY_SHOOTER}, {_BY_TEAM},
both_kinds AS (
  SELECT * FROM (SELECT 'individual' AS kind, id, name, team_id, total_points, rounds FROM by_shooter
                 ORDER BY total_points DESC, id LIMIT 1)
  UNION ALL
  SELECT * FROM (SELECT 'team', CAST(id AS BIGINT), name, id, total_points, rounds FROM by_team
                 ORDER BY total_points DESC, id LIMIT 1))
SELECT kind, CAST(id AS BIGINT) AS id, name, b.team_id, logo_data AS logo, total_points, rounds
FROM both_kinds b LEFT JOIN team_logos l ON l.team_id = b.team_id""")

oracle("site_trends", "scores rounds", f"""
SELECT strftime(r.round_date, '%Y-%m-%d') AS date, {avg("sum(s.total)", "count(*)", 1)} AS avg
FROM scores s JOIN rounds r ON s.round_id = r.id GROUP BY r.round_date""")

oracle("round_history", "scores shooters rounds", """WITH
lines AS (SELECT s.*, a.name, b.name AS sub_name,
                 row_number() OVER (PARTITION BY s.round_id ORDER BY s.shooter_id NULLS FIRST,
                   s.sub_for_shooter_id NULLS FIRST, station_1 NULLS FIRST, station_2 NULLS FIRST, station_3 NULLS FIRST,
                   station_4 NULLS FIRST, station_5 NULLS FIRST, s.total) AS seq
          FROM scores s JOIN shooters a ON s.shooter_id = a.id LEFT JOIN shooters b ON s.sub_for_shooter_id = b.id),
listed AS (SELECT round_id, CAST((seq - 1) // 10000 AS INT) AS page,
                  to_json(list({'name': name, 'stations': [station_1, station_2, station_3, station_4, station_5],
                                'total': total, 'subFor': sub_name} ORDER BY seq)) AS shooters
           FROM lines GROUP BY 1, 2)
SELECT r.id, r.team_id, strftime(r.round_date, '%Y-%m-%d') AS date, r.yardage, r.round_number AS "roundNumber",
       COALESCE(page, 0) AS page, COALESCE(CAST(shooters AS VARCHAR), '[]') AS shooters
FROM rounds r LEFT JOIN listed ON round_id = r.id""")

_FLAT = f"""
flat AS (SELECT s.round_id, r.team_id, strftime(r.round_date, '%Y-%m-%d') AS round_date, r.round_number, r.yardage,
                s.shooter_id, a.name, {ST}, s.total, s.sub_for_shooter_id, b.name AS sub_for_name
         FROM scores s JOIN rounds r ON s.round_id = r.id JOIN shooters a ON s.shooter_id = a.id
         LEFT JOIN shooters b ON s.sub_for_shooter_id = b.id)"""

oracle("round_detail", "scores shooters rounds teams", f"""WITH {_FLAT}
SELECT round_id, f.team_id, t.name AS team_name, round_date, round_number, yardage, shooter_id, f.name, {ST}, total,
       sub_for_name
FROM flat f JOIN teams t ON t.id = f.team_id""")

oracle("rounds_overview", "scores rounds teams", """
SELECT r.id, r.team_id, t.name AS team_name, strftime(r.round_date, '%Y-%m-%d') AS round_date, r.round_number,
       r.yardage, count(s.round_id) AS shooter_count
FROM rounds r JOIN teams t ON t.id = r.team_id LEFT JOIN scores s ON s.round_id = r.id
GROUP BY ALL""")

oracle("shooters_overview", "scores shooters teams", """
SELECT a.id, a.name, a.team_id, t.name AS team_name, count(s.shooter_id) AS rounds
FROM shooters a JOIN teams t ON t.id = a.team_id LEFT JOIN scores s ON s.shooter_id = a.id
GROUP BY ALL""")

# --- teams, leagues, members -----------------------------------------------------

oracle("team_directory", "teams leagues team_logos", """
SELECT t.id, t.name, o.logo_data, t.league_id, l.name AS league_name
FROM teams t LEFT JOIN leagues l ON l.id = t.league_id LEFT JOIN team_logos o ON o.team_id = t.id""")

oracle("user_directory", "users teams", """
SELECT u.id, u.email, u.name, u.phone, is_admin, is_squad_leader, team_approved, u.team_id, t.name AS team_name,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM users u LEFT JOIN teams t ON t.id = u.team_id""")

oracle("league_directory", "leagues", "SELECT * FROM leagues")

oracle("squad_leaders", "users", "SELECT name, team_id FROM users WHERE is_squad_leader AND name IS NOT NULL")

oracle("pending_members", "users", """
SELECT team_id, id, email, name, phone, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM users WHERE NOT team_approved AND team_id IS NOT NULL""")

_APPROVERS = """
able AS (SELECT team_id, email, CASE WHEN is_squad_leader THEN 1 ELSE 2 END AS tier
         FROM users WHERE team_id IS NOT NULL AND (is_squad_leader OR is_admin)),
chosen AS (SELECT * FROM able a WHERE tier = (SELECT min(tier) FROM able b WHERE b.team_id = a.team_id))"""

oracle("notification_recipients", "users", f"WITH {_APPROVERS} SELECT team_id, tier, email FROM chosen")

oracle("pending_notifications", "users teams", f"""WITH {_APPROVERS},
best AS (SELECT team_id, tier, count(*) AS recipients FROM chosen GROUP BY 1, 2),
waiting AS (SELECT team_id, id AS user_id, CASE WHEN name IS NULL THEN email ELSE name || ' (' || email || ')' END AS who
            FROM users WHERE NOT team_approved AND team_id IS NOT NULL)
SELECT w.team_id, t.name AS team_name, user_id, who, who || ' wants to join ' || t.name AS subject, tier, recipients
FROM waiting w JOIN best USING (team_id) JOIN teams t ON t.id = w.team_id""")

oracle("member_access", "users", """
SELECT id AS user_id, CASE WHEN team_approved THEN team_id END AS visible_team_id,
       CASE WHEN team_id IS NULL THEN 'no team' WHEN team_approved THEN 'member' ELSE 'pending' END AS status
FROM users""")

oracle("visible_rounds", "rounds users", """
SELECT r.id, r.team_id, strftime(round_date, '%Y-%m-%d') AS round_date, round_number, yardage, viewers
FROM rounds r JOIN (SELECT team_id, count(*) AS viewers FROM users WHERE team_approved AND team_id IS NOT NULL
                    GROUP BY team_id) v ON v.team_id = r.team_id""")

oracle("team_member_counts", "users", """
SELECT CASE WHEN team_id IS NULL THEN 'no team' ELSE 'team' END AS scope, team_id, count(*) AS members
FROM users GROUP BY team_id
UNION ALL SELECT 'site', NULL, count(*) FROM users""")

# --- derived statistics -----------------------------------------------------------

oracle("team_summary", "scores rounds teams", f"""WITH
shot AS (SELECT r.team_id, count(DISTINCT s.shooter_id) AS active_shooters,
                {avg("sum(s.total)", "count(*)", 1)} AS team_average, CAST(max(s.total) AS INT) AS best_round
         FROM scores s JOIN rounds r ON s.round_id = r.id GROUP BY 1),
logged AS (SELECT team_id, count(*) AS rounds_logged FROM rounds GROUP BY 1)
SELECT t.id AS team_id, t.name AS team_name, COALESCE(rounds_logged, 0) AS rounds_logged,
       COALESCE(active_shooters, 0) AS active_shooters, team_average, best_round
FROM teams t LEFT JOIN logged l ON l.team_id = t.id LEFT JOIN shot s ON s.team_id = t.id""")

oracle("team_trends_top5", "scores shooters rounds", f"""WITH {_POINTS},
ranked AS (SELECT team_id, name, row_number() OVER (PARTITION BY team_id ORDER BY count(*) DESC, name) AS rank
           FROM points GROUP BY team_id, name)
SELECT team_id, CAST(rank AS INT) AS rank, name, strftime(round_date, '%Y-%m-%d') AS round_date, round_number, round_id,
       total
FROM points JOIN ranked USING (team_id, name) WHERE rank <= 5""")

oracle("shooter_drilldown", "scores shooters", f"""
SELECT a.id AS shooter_id, a.name, a.team_id, count(*) AS rounds, count(sub_for_shooter_id) AS rounds_as_sub,
       {avg("sum(total)", "count(*)", 1)} AS avg_total, CAST(max(total) AS INT) AS best_total,
       {", ".join(avg(f"sum({c})", f"(5*count({c}))", 3) + f" AS accuracy_{c[-1]}" for c in STATIONS)}
FROM scores s JOIN shooters a ON s.shooter_id = a.id GROUP BY 1, 2, 3""")

oracle("shooter_history", "scores shooters rounds", f"""WITH {_FLAT}
SELECT shooter_id, name, team_id, round_date, round_number, round_id, {ST}, total,
       sub_for_shooter_id IS NOT NULL AS is_sub, sub_for_name FROM flat""")

_HITS = " UNION ALL ".join(
    f"SELECT team_id, shooter_id, {i} AS station, {c} AS hits FROM scores JOIN rounds r ON r.id = round_id"
    for i, c in enumerate(STATIONS, 1)
)
oracle("station_accuracy", "scores rounds", f"""WITH hit AS ({_HITS}),
sums AS (
  SELECT 'team' AS scope, CAST(team_id AS BIGINT) AS scope_id, station, sum(hits) AS hits, count(hits) AS shots
  FROM hit GROUP BY team_id, station
  UNION ALL
  SELECT 'shooter', shooter_id, station, sum(hits), count(hits) FROM hit GROUP BY shooter_id, station)
SELECT scope, scope_id, station, CAST(COALESCE(hits, 0) AS BIGINT) AS hits, shots,
       {avg("hits", "(5*shots)", 3)} AS accuracy FROM sums""")

oracle("next_round_number", "rounds", """
SELECT team_id, strftime(round_date, '%Y-%m-%d') AS round_date, count(*) + 1 AS next_number
FROM rounds GROUP BY team_id, rounds.round_date""")

oracle("badged_shooters", "shooters users", """
SELECT a.id, a.team_id, a.name,
       EXISTS (SELECT 1 FROM users u WHERE u.is_squad_leader AND u.name = a.name AND u.team_id = a.team_id)
         AS is_squad_leader
FROM shooters a""")

oracle("leagues_for_member", "leagues teams users", """
SELECT u.id AS user_id, t.league_id AS pinned_league_id, l.name AS pinned_league
FROM users u LEFT JOIN teams t ON t.id = u.team_id LEFT JOIN leagues l ON l.id = t.league_id""")

oracle("league_lists", "leagues teams", """
SELECT o.league_id AS own_league_id, l.id AS league_id, l.name,
       CAST(row_number() OVER (PARTITION BY o.league_id ORDER BY o.league_id IS NOT DISTINCT FROM l.id DESC, l.name, l.id) AS INT)
         AS place
FROM (SELECT DISTINCT league_id FROM teams) o, leagues l""")

oracle("history_labels", "scores shooters rounds", f"""WITH {_FLAT}
SELECT round_id, team_id, shooter_id, CASE WHEN sub_for_shooter_id IS NULL THEN name ELSE name || '*' END AS label,
       CASE WHEN sub_for_shooter_id IS NOT NULL THEN 'SUB for ' || sub_for_name END AS tag, total
FROM flat""")

# --- ingest -------------------------------------------------------------------------

_KEPT = f"""
kept AS (
  SELECT submission_id, pos, name,
         CASE WHEN lower(sub) <> lower(name) THEN sub END AS sub_for,
         {", ".join(f"CAST(st{i} AS SMALLINT) AS station_{i}" for i in range(1, 6))},
         CASE WHEN raw_total IS NULL THEN auto
              WHEN regexp_full_match(raw_total, '[0-9]+') THEN CAST(raw_total AS SMALLINT) END AS total,
         row_round_number
  FROM (SELECT *, nullif(trim(raw_name), '') AS name, nullif(trim(raw_sub_for), '') AS sub,
               CASE WHEN COALESCE(st1, st2, st3, st4, st5) IS NOT NULL
                    THEN CAST(COALESCE(st1, 0) + COALESCE(st2, 0) + COALESCE(st3, 0) + COALESCE(st4, 0)
                              + COALESCE(st5, 0) AS SMALLINT) END AS auto
        FROM submission_lines)
  WHERE name IS NOT NULL AND (raw_total IS NOT NULL OR auto IS NOT NULL))"""

_TYPED = """
typed AS (
  SELECT submission_id, team_id,
         CASE WHEN regexp_full_match(raw_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN raw_date END AS round_date,
         CASE WHEN raw_yardage IS NULL OR raw_yardage = '' THEN NULL
              WHEN trim(raw_yardage) = '' THEN CAST(0 AS SMALLINT) ELSE CAST(raw_yardage AS SMALLINT) END AS yardage,
         CASE WHEN raw_round_number IS NULL OR raw_round_number = '' THEN CAST(1 AS SMALLINT)
              ELSE CAST(raw_round_number AS SMALLINT) END AS round_number
  FROM submission_headers)"""

_VERDICTS = """
per_sheet AS (SELECT submission_id, count(*) AS n_lines FROM submission_lines GROUP BY 1),
per_bad AS (SELECT submission_id, count(*) AS bad_lines FROM kept WHERE total IS NULL GROUP BY 1),
verdicts AS (
  SELECT t.*, COALESCE(bad_lines, 0) AS bad_lines,
         CASE WHEN n_lines IS NULL THEN 'no_lines' WHEN round_date IS NULL THEN 'date'
              WHEN bad_lines > 0 THEN 'line' END AS reason
  FROM typed t LEFT JOIN per_sheet USING (submission_id) LEFT JOIN per_bad USING (submission_id))"""

_ACCEPTED = """
accepted AS (SELECT k.*, v.team_id, v.round_date, v.yardage, v.round_number
             FROM kept k JOIN verdicts v USING (submission_id) WHERE reason IS NULL)"""

_ROSTER = """
names AS (SELECT DISTINCT team_id, name FROM (SELECT team_id, name FROM accepted
          UNION ALL SELECT team_id, sub_for FROM accepted WHERE sub_for IS NOT NULL)),
roster AS (SELECT CAST(id AS BIGINT) AS id, team_id, name, false AS is_new FROM shooters
           UNION ALL SELECT NULL, team_id, name, true FROM names
           WHERE (team_id, name) NOT IN (SELECT (team_id, name) FROM shooters))"""

oracle("explode_scoresheets", "submission_lines", """
SELECT submission_id, pos, raw_name,
       CAST(st1 AS VARCHAR) AS st1, CAST(st2 AS VARCHAR) AS st2, CAST(st3 AS VARCHAR) AS st3,
       CAST(st4 AS VARCHAR) AS st4, CAST(st5 AS VARCHAR) AS st5,
       CASE WHEN COALESCE(st1, st2, st3, st4, st5) IS NOT NULL
            THEN CAST(COALESCE(st1, 0) + COALESCE(st2, 0) + COALESCE(st3, 0) + COALESCE(st4, 0)
                      + COALESCE(st5, 0) AS DOUBLE) END AS station_sum,
       raw_total, raw_sub_for, CAST(row_round_number AS VARCHAR) AS raw_row_round
FROM submission_lines""")

oracle("extract_json", "raw_extractions", r"""WITH
cut AS (SELECT event_id,
               regexp_extract(replace(regexp_replace(raw, '```json', '', 'gi'), '```', ''), '\{.*\}', 0, 's') AS body
        FROM raw_extractions)
SELECT event_id, body <> '' AND json_valid(body) AS accepted,
       CASE WHEN body <> '' AND json_valid(body) THEN CAST(json(body) AS VARCHAR) END AS parsed FROM cut""")

oracle("normalised_lines", "submission_lines", f"""WITH {_KEPT}
SELECT submission_id, pos, name, sub_for, {ST}, total, total IS NOT NULL AS valid FROM kept""")

oracle("sheet_headers", "submission_headers", f"""WITH {_TYPED}
SELECT submission_id, team_id, round_date, yardage, round_number,
       CASE WHEN round_date IS NULL THEN 'date' END AS fault FROM typed""")

oracle("rejected_submissions", "submission_headers submission_lines", f"""WITH {_KEPT}, {_TYPED}, {_VERDICTS},
named AS (SELECT *, submission_id % 53 = 0 AS strange FROM verdicts)
SELECT submission_id, bad_lines,
       CASE WHEN reason IN ('no_lines', 'date') THEN reason WHEN strange THEN 'unknown_team' ELSE reason END AS reason
FROM named WHERE reason IS NOT NULL OR strange""")

oracle("substitutions", "submission_lines", f"""WITH {_KEPT}
SELECT submission_id, pos, name, sub_for FROM kept WHERE sub_for IS NOT NULL""")

oracle("roster_after_ingest", "submission_headers submission_lines shooters", f"""
WITH {_KEPT}, {_TYPED}, {_VERDICTS}, {_ACCEPTED}, {_ROSTER}
SELECT id, team_id, name, is_new FROM roster""")

oracle("facts_after_ingest", "submission_headers submission_lines shooters", f"""
WITH {_KEPT}, {_TYPED}, {_VERDICTS}, {_ACCEPTED}, {_ROSTER}
SELECT submission_id, pos, a.team_id, round_date, yardage, round_number, a.name, sub_for, {ST}, total,
       o.id AS shooter_id, s.id AS sub_for_shooter_id
FROM accepted a JOIN roster o ON o.team_id = a.team_id AND o.name = a.name
LEFT JOIN roster s ON s.team_id = a.team_id AND s.name = a.sub_for""")

oracle("stream_ingest", "submission_headers submission_lines", f"""
WITH {_KEPT}, {_TYPED}, {_VERDICTS}, {_ACCEPTED}
SELECT submission_id, pos, team_id, round_date, round_number, yardage, name, sub_for, {ST}, total FROM accepted""")

oracle("stream_leaderboard", "submission_headers submission_lines", f"""
WITH {_KEPT}, {_TYPED}, {_VERDICTS}, {_ACCEPTED}
SELECT team_id, name, CAST(sum(total) AS BIGINT) AS total_points, count(*) AS rounds, CAST(max(total) AS INT) AS best_total
FROM accepted GROUP BY 1, 2""")

_GROUPS = """
editable AS (SELECT t.* FROM typed t LEFT JOIN per_bad USING (submission_id)
             WHERE round_date IS NOT NULL AND bad_lines IS NULL),
lined AS (SELECT e.submission_id, e.team_id, e.yardage, e.round_date,
                 CAST(COALESCE(l.row_round_number, e.round_number) AS SMALLINT) AS round_number, l.pos
          FROM editable e LEFT JOIN submission_lines l USING (submission_id)),
groups AS (SELECT submission_id, round_number, count(lined.pos) AS n_lines, count(k.pos) AS n_scores
           FROM lined LEFT JOIN kept k USING (submission_id, pos) GROUP BY 1, 2),
lowest AS (SELECT submission_id, min(round_number) AS low FROM groups GROUP BY 1)"""

oracle("split_rounds", "submission_headers submission_lines", f"""
WITH {_KEPT}, {_TYPED}, per_bad AS (SELECT submission_id, count(*) AS bad_lines FROM kept WHERE total IS NULL GROUP BY 1),
{_GROUPS}
SELECT submission_id, round_number, round_number = low AS keeps_round, n_lines, n_scores
FROM groups JOIN lowest USING (submission_id)""")

_PER_BAD = "per_bad AS (SELECT submission_id, count(*) AS bad_lines FROM kept WHERE total IS NULL GROUP BY 1)"
# What an edit asks for, and the team the round ends up with.
_MOVED = """
wished AS (SELECT t.*, CASE WHEN submission_id % 39 = 0 OR submission_id % 26 = 0 THEN team_id
                            WHEN submission_id % 65 = 0 THEN NULL ELSE CAST(team_id % 25 + 1 AS INT) END AS new_team
           FROM typed t WHERE submission_id % 13 = 0),
replaced AS (SELECT w.* FROM wished w JOIN editable USING (submission_id) WHERE new_team IS NOT NULL)"""

oracle("scores_after_edit", "scores shooters rounds submission_headers submission_lines", f"""
WITH {_KEPT}, {_TYPED}, {_PER_BAD}, {_GROUPS}, {_FLAT}, {_MOVED}
SELECT round_id AS source_id, team_id, round_number, yardage, name, sub_for_name, {ST}, total
FROM flat WHERE round_id NOT IN (SELECT submission_id FROM replaced)
UNION ALL
SELECT e.submission_id, new_team, CAST(COALESCE(k.row_round_number, e.round_number) AS SMALLINT),
       e.yardage, k.name, k.sub_for, {ST}, k.total
FROM replaced e JOIN kept k USING (submission_id)""")

oracle("rounds_after_edit", "rounds submission_headers submission_lines", f"""
WITH {_KEPT}, {_TYPED}, {_PER_BAD}, {_GROUPS}, {_MOVED}
SELECT id AS source_id, team_id, strftime(rounds.round_date, '%Y-%m-%d') AS round_date, round_number, yardage
FROM rounds WHERE id NOT IN (SELECT submission_id FROM replaced)
UNION ALL
SELECT r.submission_id, r.new_team, r.round_date, g.round_number, r.yardage
FROM replaced r JOIN groups g USING (submission_id)""")

oracle("edit_report", "submission_headers submission_lines", f"""
WITH {_KEPT}, {_TYPED}, {_PER_BAD}, {_GROUPS}, {_MOVED}
SELECT submission_id, CASE WHEN w.round_date IS NULL THEN 'date' WHEN new_team IS NULL THEN 'unknown_team' ELSE 'line' END AS reason
FROM wished w LEFT JOIN per_bad USING (submission_id)
WHERE w.round_date IS NULL OR new_team IS NULL OR bad_lines > 0""")

# --- maintenance ---------------------------------------------------------------------

oracle("patched_users", "users", """WITH
asked AS (SELECT *, id % 4 = 0 AND id % 24 <> 0 AS done FROM users)
SELECT id, email, google_id, name, phone, is_admin, is_squad_leader OR (done AND id % 12 <> 0) AS is_squad_leader,
       team_approved AND NOT (done AND id % 28 = 0) AS team_approved,
       CASE WHEN NOT done OR id % 8 <> 0 THEN team_id WHEN id % 20 = 0 THEN 3 END AS team_id
FROM asked""")

oracle("user_patch_report", "users", """
SELECT id, CASE WHEN id % 24 = 0 THEN 'unknown_team'
                WHEN id % 12 <> 0 OR id % 28 = 0 OR id % 8 = 0 THEN 'updated' ELSE 'nothing_to_update' END AS outcome
FROM users WHERE id % 4 = 0""")

oracle("patched_teams", "teams", """
SELECT id, CASE WHEN id % 2 = 0 OR id IN (3, 7) THEN name ELSE 'New ' || name END AS name,
       CASE WHEN id % 2 = 1 AND id % 3 = 0 AND id <> 3 THEN NULL ELSE league_id END AS league_id
FROM teams""")

oracle("team_patch_report", "teams", """
SELECT id, CASE id WHEN 3 THEN 'conflict' WHEN 7 THEN 'unknown_league' ELSE 'updated' END AS outcome FROM teams WHERE id % 2 = 1""")

oracle("patched_shooters", "shooters", """
SELECT id, CASE WHEN id % 10 = 0 AND id % 70 <> 0 THEN CAST(team_id % 25 + 1 AS INT) ELSE team_id END AS team_id,
       CASE WHEN id % 5 = 0 AND id % 15 <> 0 AND id % 70 <> 0 THEN 'New ' || name ELSE name END AS name
FROM shooters""")

oracle("shooter_patch_report", "shooters", """
SELECT id, CASE WHEN id % 70 = 0 THEN 'unknown_team' WHEN id % 15 = 0 AND id % 10 <> 0 THEN 'nothing_to_update'
                ELSE 'updated' END AS outcome
FROM shooters WHERE id % 5 = 0""")

_LOGOS = """
asked AS (SELECT id AS seq, CASE WHEN id % 100 = 0 THEN 999 ELSE CAST((team_id - 1 + id % 2) % 25 + 1 AS INT) END AS wanted,
                 CASE id % 4 WHEN 1 THEN 'logo.png' WHEN 2 THEN NULL ELSE 'data:image/png;' || email END AS logo_data,
                 is_admin, is_squad_leader, team_id AS own
          FROM users WHERE team_id IS NOT NULL),
judged AS (SELECT *, CASE WHEN NOT (is_admin OR (is_squad_leader AND wanted = own)) THEN 'forbidden'
                          WHEN logo_data = 'logo.png' THEN 'not_an_image' WHEN wanted = 999 THEN 'not_found'
                          WHEN logo_data IS NULL THEN 'cleared' ELSE 'set' END AS outcome FROM asked),
last AS (SELECT wanted AS team_id, arg_max({'logo': logo_data}, seq).logo AS logo_data FROM judged
         WHERE outcome IN ('set', 'cleared') GROUP BY wanted)"""

oracle("patched_logos", "users team_logos", f"""WITH {_LOGOS}
SELECT team_id, logo_data FROM team_logos WHERE team_id NOT IN (SELECT team_id FROM last)
UNION ALL SELECT team_id, logo_data FROM last WHERE logo_data IS NOT NULL""")

oracle("logo_report", "users", f"WITH {_LOGOS} SELECT seq, wanted AS team_id, outcome FROM judged")

oracle("replaced_profiles", "users", """
SELECT id, CASE WHEN id % 4 = 0 THEN email WHEN id % 2 = 1 THEN name END AS name,
       CASE WHEN id % 2 = 0 THEN '555-' || id ELSE phone END AS phone, CAST(NULL AS VARCHAR) AS address
FROM users""")

oracle("replaced_leagues", "leagues", """
SELECT id, name, CASE WHEN id % 2 = 1 THEN 'Hall' END AS location, CAST(NULL AS VARCHAR) AS contact_name,
       CAST(NULL AS VARCHAR) AS contact_email, CAST(NULL AS VARCHAR) AS contact_phone,
       CAST(NULL AS VARCHAR) AS schedule_text, CAST(NULL AS VARCHAR) AS costs_text, CAST(NULL AS VARCHAR) AS description
FROM leagues""")

_ASKED_NAMES = """
asked AS (SELECT CASE WHEN submission_id % 31 = 0 THEN 999 WHEN submission_id % 37 = 0 THEN 0 ELSE h.team_id END AS team_id,
                 trim(raw_name) AS name, submission_id, pos
          FROM submission_lines JOIN submission_headers h USING (submission_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY team_id, name ORDER BY submission_id, pos) AS turn,
                   count(*) OVER (PARTITION BY team_id, name) AS attempts FROM asked),
judged AS (SELECT o.*, CASE WHEN o.name = '' OR o.team_id = 0 THEN 'invalid' WHEN o.team_id = 999 THEN 'unknown_team'
                            WHEN s.id IS NOT NULL THEN 'conflict' ELSE 'inserted' END AS outcome
           FROM ordered o LEFT JOIN shooters s ON s.team_id = o.team_id AND s.name = o.name WHERE turn = 1)"""

oracle("keyed_insert_report", "submission_headers submission_lines shooters", f"""WITH {_ASKED_NAMES}
SELECT team_id, name, outcome, attempts,
       CASE outcome WHEN 'inserted' THEN attempts - 1 WHEN 'conflict' THEN attempts ELSE 0 END AS conflicts,
       submission_id AS first_submission_id, pos AS first_pos
FROM judged""")

oracle("shooters_after_insert", "submission_headers submission_lines shooters", f"""WITH {_ASKED_NAMES}
SELECT CAST(id AS BIGINT) AS id, team_id, name FROM shooters
UNION ALL SELECT NULL, team_id, name FROM judged WHERE outcome = 'inserted'""")

_ASKED_LEAGUES = """
asked AS (SELECT id AS seq, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'ASIA' ELSE 'League ' || (id % 7) END AS name, name AS location
          FROM teams),
judged AS (SELECT *, CASE WHEN name IS NULL THEN 'name_required' WHEN name IN (SELECT name FROM leagues) THEN 'conflict'
                          WHEN seq <> min(seq) OVER (PARTITION BY name) THEN 'conflict' ELSE 'inserted' END AS outcome FROM asked)"""

oracle("leagues_after_insert", "leagues teams", f"""WITH {_ASKED_LEAGUES}
SELECT id, name, location, contact_name FROM leagues
UNION ALL SELECT NULL, name, location, NULL FROM judged WHERE outcome = 'inserted'""")

oracle("league_insert_report", "leagues teams", f"WITH {_ASKED_LEAGUES} SELECT seq, name, outcome FROM judged")

_INTAKE = """
clean AS (SELECT seq, lower(trim(raw_email)) AS email, nullif(trim(raw_name), '') AS name, nullif(trim(new_team_name), '') AS new_team,
                 CASE WHEN nullif(trim(new_team_name), '') IS NULL THEN nullif(team_id, 0) END AS team_id
          FROM applicants),
fine AS (SELECT seq, email FROM clean WHERE contains(email, '@') AND (team_id IS NULL OR team_id IN (SELECT id FROM teams))),
winner AS (SELECT email, min(seq) AS seq FROM fine GROUP BY email),
judged AS (SELECT c.*, CASE WHEN NOT contains(c.email, '@') THEN 'invalid_email'
                            WHEN c.email IN (SELECT email FROM users) OR c.seq > w.seq THEN 'email_taken'
                            WHEN team_id NOT IN (SELECT id FROM teams) THEN 'unknown_team'
                            ELSE 'created' END AS outcome
           FROM clean c LEFT JOIN winner w ON w.email = c.email)"""

oracle("teams_after_intake", "applicants users teams", f"""WITH {_INTAKE}
SELECT id, name, league_id FROM teams
UNION ALL
SELECT DISTINCT NULL, new_team, NULL FROM judged
WHERE outcome = 'created' AND new_team IS NOT NULL AND new_team NOT IN (SELECT name FROM teams)""")

oracle("users_after_intake", "applicants users teams", f"""WITH {_INTAKE}
SELECT u.id, u.email, u.name, is_admin, is_squad_leader, team_approved, t.name AS team
FROM users u LEFT JOIN teams t ON t.id = u.team_id
UNION ALL
SELECT NULL, email, j.name, false, new_team IS NOT NULL, new_team IS NOT NULL OR j.team_id IS NULL, COALESCE(new_team, t.name)
FROM judged j LEFT JOIN teams t ON t.id = j.team_id WHERE outcome = 'created'""")

_ALL_SCORES = f"round_id, shooter_id, sub_for_shooter_id, {ST}, total"
oracle("teams_after_intake", "applicants users teams", """WITH
clean AS (SELECT seq, lower(trim(raw_email)) AS email, nullif(trim(new_team_name), '') AS new_team FROM applicants),
made AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY seq) AS turn FROM clean
         WHERE contains(email, '@') AND email NOT IN (SELECT email FROM users))
SELECT id, name, league_id FROM teams
UNION ALL
SELECT DISTINCT NULL, new_team, NULL FROM made
WHERE turn = 1 AND new_team IS NOT NULL AND new_team NOT IN (SELECT name FROM teams)""")

oracle("after_delete_users", "users", "SELECT id, email FROM users WHERE id % 9 <> 0 OR id = 18")

oracle("after_delete_rounds", "scores rounds", f"""
SELECT {_ALL_SCORES} FROM scores WHERE round_id NOT IN (SELECT id FROM rounds WHERE id % 11 = 0)""")

oracle("after_delete_shooters", "scores shooters", f"""WITH gone AS (SELECT id FROM shooters WHERE id % 7 = 0)
SELECT round_id, shooter_id,
       CASE WHEN sub_for_shooter_id NOT IN (SELECT id FROM gone) THEN sub_for_shooter_id END AS sub_for_shooter_id,
       {ST}, total
FROM scores WHERE shooter_id NOT IN (SELECT id FROM gone)""")

_GONE_TEAMS = """
gone AS (SELECT id FROM teams WHERE id % 5 = 0
         AND id NOT IN (SELECT team_id FROM users WHERE team_id IS NOT NULL))"""

oracle("after_delete_teams", "scores shooters rounds teams users", f"""WITH {_GONE_TEAMS},
gone_shooters AS (SELECT id FROM shooters WHERE team_id IN (SELECT id FROM gone)),
gone_rounds AS (SELECT id FROM rounds WHERE team_id IN (SELECT id FROM gone))
SELECT round_id, shooter_id,
       CASE WHEN sub_for_shooter_id NOT IN (SELECT id FROM gone_shooters) THEN sub_for_shooter_id END
         AS sub_for_shooter_id, {ST}, total
FROM scores
WHERE round_id NOT IN (SELECT id FROM gone_rounds) AND shooter_id NOT IN (SELECT id FROM gone_shooters)""")

oracle("teams_after_delete", "teams users", f"""WITH {_GONE_TEAMS}
SELECT * FROM teams WHERE id NOT IN (SELECT id FROM gone)""")

oracle("shooters_after_delete", "teams users shooters", f"""WITH {_GONE_TEAMS}
SELECT * FROM shooters WHERE team_id NOT IN (SELECT id FROM gone)""")

oracle("rounds_after_delete", "teams users rounds", f"""WITH {_GONE_TEAMS}
SELECT id, team_id, strftime(rounds.round_date, '%Y-%m-%d') AS round_date, round_number, yardage
FROM rounds WHERE team_id NOT IN (SELECT id FROM gone)""")

oracle("team_delete_report", "teams users", """
SELECT t.id, t.name, count(u.id) AS members, CASE WHEN count(u.id) > 0 THEN 'has_members' ELSE 'deleted' END AS outcome
FROM teams t LEFT JOIN users u ON u.team_id = t.id 
WHERE t.id % 5 = 0 GROUP BY 1, 2""")

oracle("after_delete_leagues", "teams", """
SELECT id, name, CASE WHEN league_id <> 2 THEN league_id END AS league_id FROM teams""")

oracle("account_intake", "applicants users teams", f"""WITH {_INTAKE}
SELECT seq, email, CASE WHEN outcome = 'created' THEN name END AS name, outcome,
       CASE WHEN outcome = 'created' THEN new_team END AS new_team,
       CASE WHEN outcome = 'created' THEN team_id END AS joined_team_id,
       CASE WHEN outcome = 'created' THEN false END AS is_admin,
       CASE WHEN outcome = 'created' THEN new_team IS NOT NULL END AS is_squad_leader,
       CASE WHEN outcome = 'created' THEN new_team IS NOT NULL OR team_id IS NULL END AS team_approved,
       CASE WHEN outcome = 'created' THEN new_team IS NOT NULL AND new_team IN (SELECT name FROM teams) END
         AS names_existing_team
FROM judged""")

# In the order of the batch: each row asks what the sign-ins before it have left behind. No external id comes with two emails.
_SIGN_INS = """
seen AS (SELECT seq, external_id, lower(trim(raw_email)) AS email, raw_name, email_verified AS ok FROM identities),
homes AS (SELECT s.*, g.id AS home_id, g.email AS home_email,
                 EXISTS (SELECT 1 FROM seen o WHERE o.ok AND o.email = g.email AND o.external_id <> s.external_id AND o.seq < s.seq)
                   AS replaced
          FROM seen s LEFT JOIN users g ON g.google_id = s.external_id),
away AS (SELECT *, home_id IS NOT NULL AND NOT replaced AS home FROM homes),
chain AS (SELECT *, lag(external_id) OVER (PARTITION BY email ORDER BY seq) AS last_id,
                 row_number() OVER (PARTITION BY email ORDER BY seq) AS turn
          FROM away WHERE ok AND NOT (home AND home_email <> email)),
matched AS (
  SELECT c.seq, c.external_id, c.email, e.id AS user_id, c.raw_name,
         CASE WHEN e.id IS NULL AND turn = 1 THEN 'created'
              WHEN turn = 1 AND e.google_id = external_id OR last_id = external_id THEN 'signed_in' ELSE 'linked' END AS outcome
  FROM chain c LEFT JOIN users e ON e.email = c.email
  UNION ALL
  SELECT seq, external_id, email, CASE WHEN ok THEN home_id END, raw_name, CASE WHEN ok THEN 'signed_in' ELSE 'rejected' END
  FROM away WHERE NOT ok OR (home AND home_email <> email))"""

oracle("identity_match", "identities users", f"""WITH {_SIGN_INS}
SELECT seq, external_id, email, user_id, outcome FROM matched""")

oracle("users_after_sign_in", "identities users", f"""WITH {_SIGN_INS},
tied AS (SELECT email, arg_max(external_id, seq) AS held FROM matched WHERE outcome IN ('linked', 'created') GROUP BY email)
SELECT id, u.email, COALESCE(held, google_id) AS google_id, name, is_admin, is_squad_leader, team_approved, team_id
FROM users u LEFT JOIN tied ON tied.email = u.email
UNION ALL
SELECT NULL, m.email, held, nullif(trim(raw_name), ''), false, false, true, NULL
FROM matched m JOIN tied ON tied.email = m.email WHERE outcome = 'created'""")

# One request after the other, as the site handles them.
_REQUESTS = """
asked AS (
  SELECT r.seq, r.user_id, r.action, nullif(r.team_id, 0) AS wanted, nullif(trim(r.team_name), '') AS new_name,
         row_number() OVER (PARTITION BY r.user_id ORDER BY r.seq) AS turn
  FROM membership_requests r),
turns AS (
  SELECT a.*, t.name AS wanted_name FROM asked a LEFT JOIN teams t ON t.id = a.wanted),
walk AS (
  SELECT u.id, u.is_admin, CAST(0 AS BIGINT) AS turn, t.name AS team, u.team_approved, u.is_squad_leader,
         CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS outcome
  FROM users u LEFT JOIN teams t ON t.id = u.team_id
  UNION ALL
  SELECT id, is_admin, turn,
         CASE WHEN outcome = 'created' THEN new_name WHEN outcome IN ('joined', 'pending') THEN wanted_name
              WHEN outcome <> 'denied' THEN team END,
         CASE WHEN outcome IN ('created', 'joined', 'approved', 'denied') THEN true WHEN outcome = 'pending' THEN false
              ELSE team_approved END,
         is_squad_leader OR outcome = 'created', seq, action, outcome
  FROM (SELECT w.id, w.is_admin, t.turn, w.team, w.team_approved, w.is_squad_leader, t.seq, t.action, t.new_name, t.wanted_name,
               CASE WHEN t.action IN ('join', 'create') THEN
                      CASE WHEN w.team IS NOT NULL THEN 'already_on_a_team' WHEN t.new_name IS NOT NULL THEN 'created'
                           WHEN t.wanted IS NULL THEN 'no_team_given' WHEN t.wanted_name IS NULL THEN 'unknown_team'
                           WHEN w.is_admin THEN 'joined' ELSE 'pending' END
                    WHEN w.team IS NULL OR t.wanted_name IS NULL OR w.team <> t.wanted_name THEN 'other_team'
                    WHEN t.action = 'approve' THEN 'approved' ELSE 'denied' END AS outcome
        FROM walk w JOIN turns t ON t.user_id = w.id AND t.turn = w.turn + 1) x)"""

oracle("membership_after_requests", "users teams membership_requests", f"""WITH RECURSIVE {_REQUESTS}
SELECT id, team, team_approved, is_squad_leader FROM walk
WHERE turn = (SELECT count(*) FROM membership_requests r WHERE r.user_id = walk.id)""")

oracle("membership_request_outcomes", "users teams membership_requests", f"""WITH RECURSIVE {_REQUESTS}
SELECT seq, id AS user_id, action, outcome FROM walk WHERE turn > 0
UNION ALL
SELECT seq, user_id, action, 'unknown_user' FROM membership_requests WHERE user_id NOT IN (SELECT id FROM users)""")

oracle("teams_after_requests", "users teams membership_requests", f"""WITH RECURSIVE {_REQUESTS}
SELECT id, name, league_id FROM teams
UNION ALL
SELECT DISTINCT NULL, team, NULL FROM walk WHERE outcome = 'created' AND team NOT IN (SELECT name FROM teams)""")

oracle("backfilled_rounds", "rounds teams", """
SELECT id, CASE WHEN id % 3 = 0 THEN (SELECT max(id) + 1 FROM teams) ELSE team_id END AS team_id,
       strftime(round_date, '%Y-%m-%d') AS round_date, round_number, yardage
FROM rounds""")

oracle("upgraded_rounds", "rounds", """
SELECT id, team_id, strftime(round_date, '%Y-%m-%d') AS round_date,
       CASE WHEN rounds.round_date < DATE '1995-01-01' THEN CAST(1 AS SMALLINT) ELSE round_number END AS round_number,
       CASE WHEN rounds.round_date < DATE '1995-01-01' THEN NULL ELSE yardage END AS yardage
FROM rounds""")

_DELETES = """
asked AS (SELECT d.*, coalesce(u.is_admin, false) AS is_admin, u.team_id AS own_team
          FROM delete_requests d LEFT JOIN users u ON u.id = d.requested_by),
targets AS (SELECT 'round' AS kind, id, team_id FROM rounds UNION ALL SELECT 'shooter', id, team_id FROM shooters
            UNION ALL SELECT 'team', id, id FROM teams UNION ALL SELECT 'league', id, NULL FROM leagues
            UNION ALL SELECT 'user', id, NULL FROM users),
judged AS (SELECT a.seq, a.kind, a.id, a.requested_by, t.team_id,
                  CASE WHEN a.kind = 'round' AND t.id IS NULL THEN 'not_found'
                       WHEN NOT (is_admin OR coalesce(a.kind = 'round' AND t.team_id = own_team, false)) THEN 'forbidden'
                       WHEN t.id IS NULL THEN 'not_found'
                       WHEN a.kind = 'user' AND a.id = a.requested_by THEN 'own_account' END AS fault
           FROM asked a LEFT JOIN targets t ON t.kind = a.kind AND t.id = a.id),
firsts AS (SELECT kind, id, min(seq) AS seq FROM judged WHERE fault IS NULL AND kind <> 'team' GROUP BY 1, 2),
held AS (SELECT u.team_id, max(coalesce(f.seq, 1000000000000)) AS until
         FROM users u LEFT JOIN firsts f ON f.kind = 'user' AND f.id = u.id GROUP BY 1),
closed AS (SELECT j.id, min(j.seq) AS seq FROM judged j LEFT JOIN held h ON h.team_id = j.id
           WHERE j.kind = 'team' AND fault IS NULL AND j.seq > coalesce(h.until, -1) GROUP BY 1),
told AS (SELECT j.seq, j.kind, j.id, j.requested_by, j.team_id, CASE
           WHEN fault IS NOT NULL THEN fault
           WHEN j.kind = 'team' AND (c.seq IS NULL OR j.seq < c.seq) THEN 'has_members'
           WHEN j.kind = 'team' AND j.seq = c.seq THEN 'deleted'
           WHEN c.seq < j.seq OR j.seq > f.seq THEN 'not_found' ELSE 'deleted' END AS outcome
         FROM judged j LEFT JOIN closed c ON c.id = j.team_id LEFT JOIN firsts f ON f.kind = j.kind AND f.id = j.id)"""

oracle("delete_report", "delete_requests rounds shooters teams leagues users", f"""WITH {_DELETES}
SELECT seq, kind, CAST(id AS BIGINT) AS id, CAST(requested_by AS BIGINT) AS requested_by, outcome FROM told""")

oracle("scores_after_requests", "delete_requests rounds shooters teams leagues users scores", f"""WITH {_DELETES},
lost AS (SELECT kind, id FROM told WHERE outcome = 'deleted'),
no_round AS (SELECT id FROM lost WHERE kind = 'round' UNION SELECT r.id FROM rounds r JOIN lost l ON l.kind = 'team' AND l.id = r.team_id),
no_shooter AS (SELECT id FROM lost WHERE kind = 'shooter' UNION SELECT s.id FROM shooters s JOIN lost l ON l.kind = 'team' AND l.id = s.team_id)
SELECT round_id, shooter_id, CASE WHEN sub_for_shooter_id NOT IN (SELECT id FROM no_shooter) THEN sub_for_shooter_id END AS sub_for_shooter_id, {ST}, total
FROM scores WHERE round_id NOT IN (SELECT id FROM no_round) AND shooter_id NOT IN (SELECT id FROM no_shooter)""")

oracle("submitted_headers", "sent_headers users", """
WITH placed AS (
  SELECT h.*, u.id IS NOT NULL OR h.user_id IS NULL AS known_sender,
         CAST(CASE WHEN h.user_id IS NULL THEN h.team_id WHEN u.is_admin THEN coalesce(nullif(h.team_id, 0), u.team_id) ELSE u.team_id END AS INT) AS team
  FROM sent_headers h LEFT JOIN users u ON u.id = h.user_id)
SELECT submission_id, CAST(user_id AS BIGINT) AS user_id, team AS team_id, known_sender,
       CASE WHEN raw_date <> 'not-a-date' THEN raw_date END AS round_date, CAST(NULL AS SMALLINT) AS yardage,
       CAST(raw_round_number AS SMALLINT) AS round_number,
       CASE WHEN team IS NULL THEN 'team' WHEN raw_date = 'not-a-date' THEN 'date' END AS fault
FROM placed""")

oracle("upgraded_scores", "scores", f"""
SELECT round_id, shooter_id, CASE WHEN round_id % 2 = 1 THEN CAST(sub_for_shooter_id AS BIGINT) END AS sub_for_shooter_id, {ST}, total
FROM scores""")

oracle("upgraded_users", "users", """
SELECT CAST(id AS BIGINT) AS id, email, CASE WHEN id % 3 = 2 THEN google_id END AS google_id,
       CASE WHEN id % 3 > 0 THEN name END AS name, CASE WHEN id % 3 > 0 THEN phone END AS phone, CAST(NULL AS VARCHAR) AS address,
       is_admin, id % 3 = 2 AND is_squad_leader AS is_squad_leader, id % 3 < 2 OR team_approved AS team_approved, team_id
FROM users""")


# The rules of the stored schema, one by one.
_RULES = """
leagues: not null id | not null name | unique id | unique name
teams: not null id | not null name | unique id | unique name | league_id in leagues
users: not null id | not null email | not null is_admin | not null is_squad_leader | not null team_approved
users: not null created_at | unique id | unique email | unique google_id | team_id in teams
shooters: not null id | not null team_id | not null name | unique id | unique team_id,name | team_id in teams
rounds: not null id | not null team_id | not null round_date | not null round_number | unique id | team_id in teams
scores: not null round_id | not null shooter_id | not null total
scores: round_id in rounds | shooter_id in shooters | sub_for_shooter_id in shooters
"""


def _constraints() -> str:
    parts = []
    for line in _RULES.strip().splitlines():
        table, rules = line.split(": ")
        for rule in rules.split(" | "):
            if rule.startswith("not null "):
                c = rule.removeprefix("not null ")
                count = f"count(*) FILTER (WHERE {c} IS NULL) FROM {table}"
            elif rule.startswith("unique "):
                keys = rule.removeprefix("unique ").split(",")
                filled = " AND ".join(f"{k} IS NOT NULL" for k in keys)
                count = (f"CAST(COALESCE(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {table} WHERE {filled} "
                         f"GROUP BY {', '.join(keys)})")
            else:
                column, parent = rule.split(" in ")
                count = f"count(*) FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {parent})"
            select, rest = count.split(" FROM ", 1)
            parts.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule, {select} AS violations FROM {rest}")
    parts.append("SELECT 'teams', 'logo_data is an image', "
                 "count(*) FILTER (WHERE NOT starts_with(logo_data, 'data:image/')) FROM team_logos")
    return "\nUNION ALL ".join(parts)


oracle("constraint_violations", "leagues teams users shooters rounds scores team_logos", _constraints())
