"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_NORM = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

OP10 = f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, sha256({_NORM}) AS text_sha256 FROM documents),
     w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

# Sources sorted by cap/weight: those before the first at which the common level stays below are capped.
OP3 = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
     r AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] * 1e0 AS w, source_size * 2e0 AS cap FROM s),
     o AS (SELECT *, 1.5e0 * sum(source_size) OVER () AS pool,
                  coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
     l AS (SELECT arg_min((pool - before) / rest, cap / w) FILTER ((pool - before) / rest <= cap / w) AS level FROM o),
     t AS (SELECT source, source_size, least(cap, w * level) AS target FROM r, l),
     x AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
     c AS (SELECT *, CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496e0
                                                  < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM x)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

# Base32 of a SHA-1: each five hexadecimal digits are four digits of base32.
_B32 = """array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * k AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31), 1)), '')), '')"""
_HOST = "split_part(CASE WHEN contains(lower(url), '://') THEN substr(lower(url), strpos(lower(url), '://') + 3) ELSE lower(url) END, '/', 1)"
_REST = "CASE WHEN contains(lower(url), '://') THEN substr(lower(url), strpos(lower(url), '://') + 3) ELSE lower(url) END"

OP5 = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first, {_HOST} AS host, {_REST} AS rest FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(host, '^www\\.', ''), '.')), ',') || ')' || substr(rest, strlen(host) + 1) AS url_key,
       1577836800 + page_id AS captured_at
FROM g
"""

_TERMS = """unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents), b AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
     t AS (SELECT row, doc_id, {_TERMS} FROM d), q AS (SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, {_TERMS} FROM b)),
     s AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY row),
     c AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS total FROM s),
     f AS (SELECT row, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY row, term),
     w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term),
     p AS (SELECT row, s.doc_id, 50 + (50 * n * documents) // total AS m FROM s, c),
     r AS (SELECT item, item_id, p.doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM q JOIN f USING (term) JOIN w USING (term) JOIN p USING (row) GROUP BY item, item_id, p.doc_id, row),
     o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""

ORACLES: dict[str, str] = {"op3_mixing": OP3, "op5_warc": OP5, "op10_exact_dedup": OP10, "op13_search": OP13}
