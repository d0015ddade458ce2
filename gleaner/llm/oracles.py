"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""
WITH lines AS (
  SELECT row, doc_id, ord, split[ord] AS line,
         translate(trim(split[ord], {SPACES}), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT row, doc_id, split, unnest(range(1, len(split) + 1)) AS ord
        FROM (SELECT row_number() OVER () AS row, doc_id,
                     string_split(coalesce(text, ''), chr(10)) AS split FROM documents))
), settled AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT row, doc_id, ord, line, coalesce(doc_id <> last, false) AS gone
  FROM lines LEFT JOIN settled USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row, doc_id
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""
WITH words AS (
  SELECT row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS words
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), held AS (SELECT row, doc_id, len(words) AS n, words FROM words WHERE len(words) > 0
), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM held
), found AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, n, unnest(words) AS term FROM held) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM found GROUP BY term), totals
), asked AS (
  SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
), scores AS (
  SELECT item, item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN found USING (term), totals
  GROUP BY item, item_id, row, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": OP11, "op13_lexical_search": OP13}
