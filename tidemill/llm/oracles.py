"""The queries' contracts in SQL for DuckDB, where SQL can say them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, fold: bool) -> str:
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')" if fold else "coalesce(text, '')"
    return f"regexp_extract_all({text}, '{pattern}')"


_SPACED, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_words(_ALNUM, True)} AS ws FROM documents),
i AS (SELECT item_id, {_words(_ALNUM, True)} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(list_slice(ws, k, k + least(13, len(ws)) - 1), ' ') AS win
       FROM i, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) t(k) WHERE len(ws) > 0),
widths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS win FROM d, widths, unnest(range(1, len(ws) - n + 2)) t(k)),
hits AS (SELECT doc_id, item_id, k, dw.n AS n FROM dw JOIN iw USING (n, win)),
spots AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hits, unnest(range(0, n)) r(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_SPACED, True)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, k, k + 4), ' ') AS shingle FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM both_have JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_words(_SPACED, False)} AS ws FROM documents),
w AS (SELECT doc_id, k, array_to_string(list_slice(ws, k, k + 34), ' ') AS win FROM d, unnest(range(1, len(ws) - 33)) t(k)),
twice AS (SELECT win FROM w GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM w SEMI JOIN twice USING (win), unnest(range(0, 35)) r(j)),
spot AS (SELECT doc_id, k, ws[k] AS word FROM d, unnest(range(1, len(ws) + 1)) t(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM spot ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
