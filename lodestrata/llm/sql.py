"""DuckDB SQL for the rows of the queries that SQL can express, each written without the operator's method."""

from __future__ import annotations

import re

from .chat import INST, ROLE_END
from .decontaminate import MIN_SHARE, MIN_WORDS, PENALTY

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(sha: str) -> str:
    """Of 40 hexadecimal digits: five of them are four letters."""
    fives = [f"('0x' || substr({sha}, {5 * i + 1}, 5))::BIGINT" for i in range(8)]
    return " || ".join(f"substr('{BASE32}', ((({v}) >> {shift}) & 31)::INTEGER + 1, 1)" for v in fives for shift in (15, 10, 5, 0))


WARC_SQL = f"""
WITH digested AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
firsts AS (SELECT sha, min(page_id) AS first_id FROM digested GROUP BY sha)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_base32("sha")} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM digested JOIN firsts USING (sha)
"""


def chat_sql() -> str:
    """Each control string inside a text, and each escape, is one character longer when quoted."""
    pattern = "|".join(re.escape(x) for x in sorted({*INST.controls, INST.escape}, key=lambda x: (-len(x), x)))
    longer = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{pattern}'))"
    frame = " ".join(f"WHEN '{r}' THEN {len(INST.before[r]) + len(INST.after[r])}" for r in ("system", "user", "assistant"))
    other = len(INST.before["*"]) + len(INST.after["*"]) + len(ROLE_END)
    return f"""
WITH spoken AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
         CASE WHEN role IN ('system', 'user', 'assistant') THEN role END AS known FROM spoken),
judged AS (
  SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_it,
         last_value(known IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS at_last FROM numbered)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({longer("text")} + CASE role {frame} ELSE {other} + {longer("role")} END)::BIGINT AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN before_it IS NULL
                          WHEN 'user' THEN before_it IS NULL OR before_it IN ('system', 'assistant')
                          WHEN 'assistant' THEN before_it IS NOT NULL AND before_it = 'user'
                          ELSE false END) AND coalesce(max(at_last), '') = 'assistant' AS valid
FROM judged GROUP BY conv_id
"""


#: All diagonals of all documents and items, without seeds. On a diagonal the i-th match stands at place p of the item; a
#: run from match a to match b scores (b - a + 1) less PENALTY for each place between that is no match.
LEAKS_SQL = rf"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS words FROM documents),
items AS (SELECT item_id, row_number() OVER () AS k, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS words
          FROM (SELECT DISTINCT item_id, text FROM benchmark)),
long_items AS (SELECT *, len(words) AS n, least({MIN_WORDS}, ceil({MIN_SHARE} * len(words))) AS least_n FROM items WHERE len(words) >= 5),
doc_words AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS spot FROM docs),
item_words AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM long_items),
same AS (SELECT r, k, spot - p AS shift, p FROM doc_words JOIN item_words USING (w)),
enough AS (SELECT r, k, shift FROM same GROUP BY ALL HAVING count(*) >= 4),
counted AS (
  SELECT r, k, shift, p, row_number() OVER d AS i FROM same JOIN enough USING (r, k, shift)
  WINDOW d AS (PARTITION BY r, k, shift ORDER BY p)),
scored AS (SELECT *, {PENALTY + 1} * i - {PENALTY} * p AS f FROM counted),
lowest AS (SELECT *, min(f) OVER (PARTITION BY r, k, shift ORDER BY p ROWS UNBOUNDED PRECEDING) AS low FROM scored),
tops AS (SELECT r, k, shift, max(f - low) AS top FROM lowest GROUP BY ALL),
ends AS (SELECT r, k, shift, min(p) AS p_end FROM lowest JOIN tops USING (r, k, shift) WHERE f - low = top GROUP BY ALL),
ended AS (SELECT r, k, shift, p_end, i AS i_end, low AS low_end FROM ends JOIN lowest USING (r, k, shift) WHERE p = p_end),
begun AS (
  SELECT r, k, shift, p_end, i_end, min(p) AS p_begin, min(i) AS i_begin
  FROM ended JOIN lowest USING (r, k, shift) WHERE p <= p_end AND f = low_end GROUP BY ALL),
segments AS (
  SELECT r, k, i_end - i_begin + 1 AS n_matched, p_end - p_begin + 1 AS n_aligned, p_begin + shift AS first_word FROM begun),
best AS (
  SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY n_matched DESC, first_word) AS nth
  FROM segments JOIN long_items USING (k) WHERE n_matched >= least_n)
SELECT doc_id, item_id, n_matched::INTEGER AS n_matched, n_aligned::INTEGER AS n_aligned, n::INTEGER AS item_words, first_word::INTEGER AS first_word
FROM best JOIN docs USING (r) WHERE nth = 1
"""
