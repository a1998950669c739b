"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force, a round trip or held-out accuracy."""

from __future__ import annotations

from tidewater.llm.decontaminate import LOWER, UPPER

#: Fixed values, as the rules are stated: kind, pattern, the group whose length counts, and the least length.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '{_ITEM_WORDS}') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_lowered("text")}, '{_ITEM_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT item_id, array_to_string(w[s:s + 12], ' ') AS win, least(len(w), 13) AS n FROM i, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS t(s) WHERE len(w) > 0),
placed AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM win), unnest(generate_series(1, len(w) - n + 1)) AS t(s)),
hit AS (SELECT * FROM placed SEMI JOIN win USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(s, s + n - 1)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit JOIN win USING (win, n)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _secrets() -> str:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        regex = pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {order} AS o, '{kind}' AS kind, regexp_extract_all(t, '{regex}', 0) AS m, regexp_extract_all(t, '{regex}', {group}) AS g, string_split_regex(t, '{regex}') AS gap, {least} AS least FROM d")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT doc_id, o, kind, CAST(list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(m[k]) AS size FROM found, unnest(generate_series(1, len(m))) AS t(k) WHERE length(g[k]) >= least),
joined AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(concat(kind, ':', start, ':', start + size), ',' ORDER BY start, o) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (doc_id)"""


_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda k: concat(w[k], ' ', w[k + 1]))) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS x FROM s),
linked AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN least_ ON a = doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"SELECT * FROM ({_DECONTAMINATE})",
    "op3_secret_scan": f"SELECT * FROM ({_secrets()})",
    "op8_near_duplicates": f"SELECT * FROM ({_NEAR})",
}
