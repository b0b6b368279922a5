"""The queries of this folder that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from tallyline.llm.shared import WORD

_REMOVED = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50) x
),
firsts AS (SELECT run, min(doc_id) AS lo FROM windows GROUP BY run HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k
  FROM windows JOIN firsts USING (run) WHERE doc_id > lo
),
each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text
  FROM each_word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# The pages of the table hold their text in an article element of plain paragraphs.
_ARTICLES = r"""
WITH body AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages
),
blocks AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(
    inner_html, '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(p|h1)>', chr(1), 'g'), chr(1)) AS parts FROM body
),
lines AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(
    x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS kept FROM blocks
)
SELECT page_id, url, array_to_string(kept, chr(10)) AS text, CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars
FROM lines
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_FOLDED_WORD}') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_FOLD}, '{_FOLDED_WORD}') AS words FROM benchmark WHERE item_id IS NOT NULL
),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS run
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0) x
),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS run
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM split CROSS JOIN sizes WHERE len(words) >= n) x
),
hits AS (SELECT doc_id, i, runs.n, item_id FROM runs JOIN windows ON runs.run = windows.run AND runs.n = windows.n),
places AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) x GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) x GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM split LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_COMMON = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
each_line AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS k FROM split),
keyed AS (
  SELECT doc_id, line, k, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each_line
),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS text FROM keyed ANTI JOIN common USING (key) GROUP BY doc_id
)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, len(parts) - coalesce(kept.n, 0) AS n_dropped,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

# The damage needs CRC-32, which is spelled out bit by bit. The repair goes row by row: of every state (nothing yet,
# system, user, assistant last) the least cost and the first audit with it.
_REPAIRS = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS codes
  FROM conversations
),
fated AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(codes, lambda c, b: list_reduce(range(8),
    lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295), 4294967295) % 20 AS fate FROM coded
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE fate <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM damaged
),
judged AS (
  SELECT conv_id, turn, role, text, k, left(role, 1) AS letter,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'f' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS earlier
  FROM placed
),
steps AS (
  SELECT conv_id, 0 AS k, {'c': 0, 'a': ''} AS none, {'c': 1000000000, 'a': ''} AS sys,
         {'c': 2, 'a': 'I'} AS usr, {'c': 4, 'a': 'II'} AS ass
  FROM (SELECT DISTINCT conv_id FROM judged) x
  UNION ALL
  SELECT conv_id, k, none, sys, usr, list_sort([ass, {'c': usr.c + 2, 'a': usr.a || 'I'}])[1] AS ass
  FROM (
    SELECT conv_id, k, none, sys, ass, list_sort([usr, {'c': none.c + 2, 'a': none.a || 'I'}, {'c': sys.c + 2, 'a': sys.a || 'I'},
      {'c': ass.c + 2, 'a': ass.a || 'I'}])[1] AS usr
    FROM (
      SELECT s.conv_id, r.k, {'c': none.c + 3, 'a': none.a || 'D'} AS none,
        list_sort([{'c': sys.c + 3, 'a': sys.a || 'D'}, {'c': none.c + t + if(letter = 's', gone, 1000000000), 'a': none.a || 'K'}])[1] AS sys,
        list_sort([{'c': usr.c + 3, 'a': usr.a || 'D'},
          {'c': none.c + t + if(letter = 'u', gone, 1000000000), 'a': none.a || 'K'}, {'c': none.c + t + gone + 2, 'a': none.a || 'R'},
          {'c': sys.c + t + if(letter = 'u', gone, 1000000000), 'a': sys.a || 'K'}, {'c': sys.c + t + gone + 2, 'a': sys.a || 'R'},
          {'c': ass.c + t + if(letter = 'u', gone, 1000000000), 'a': ass.a || 'K'}, {'c': ass.c + t + gone + 2, 'a': ass.a || 'R'}])[1] AS usr,
        list_sort([{'c': ass.c + 3, 'a': ass.a || 'D'},
          {'c': usr.c + t + if(letter = 'a', gone, 1000000000), 'a': usr.a || 'K'}, {'c': usr.c + t + gone + 2, 'a': usr.a || 'R'}])[1] AS ass
      FROM steps s JOIN (
        SELECT *, if(fault = 't', 1, 0) AS t, if(fault IN ('b', 'd'), 1000000000, 0) AS gone FROM judged
      ) r ON r.conv_id = s.conv_id AND r.k = s.k + 1
    ) x
  ) y
),
sums AS (
  SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (earlier IS NOT NULL AND earlier || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
best AS (
  SELECT sums.*, list_sort([none, ass])[1] AS found FROM sums JOIN steps ON steps.conv_id = sums.conv_id AND steps.k = sums.n
),
told AS (
  SELECT conv_id, 0 AS i, 0 AS k, 'n' AS state, CAST(NULL AS VARCHAR) AS text FROM best
  UNION ALL
  SELECT conv_id, i + 1, if(edit = 'I', k, k + 1), if(edit = 'D', state, if(edit = 'K', letter, left(follower, 1))),
         CASE WHEN edit = 'D' THEN text ELSE concat_ws(chr(10), text,
           if(edit = 'K', role, follower) || ':' || if(edit = 'I', '', said)) END
  FROM (
    SELECT t.conv_id, t.i, t.k, t.state, t.text, substr(b.found.a, CAST(t.i + 1 AS INTEGER), 1) AS edit, r.letter, r.role, r.text AS said,
           if(t.state = 'u', 'assistant', 'user') AS follower
    FROM told t JOIN best b ON b.conv_id = t.conv_id AND t.i < length(b.found.a)
    LEFT JOIN judged r ON r.conv_id = t.conv_id AND r.k = t.k + 1
  ) x
),
digests AS (
  SELECT told.conv_id, sha256(coalesce(told.text, '')) AS repaired_sha256
  FROM told JOIN best ON best.conv_id = told.conv_id AND told.i = length(best.found.a)
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.found.c, 0) AS BIGINT) AS cost,
       coalesce(best.found.a, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id = c.conv_id
LEFT JOIN digests ON digests.conv_id = c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substring_dedup": _REMOVED, "op7_html_extraction": _ARTICLES, "op10_decontaminate": _HITS,
        "op11_conversation_repair": _REPAIRS, "op12_line_dedup": _COMMON,
    }
