"""SQL (DuckDB) with the results of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"


REPEATED_WINDOWS = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d),
r AS (SELECT doc_id, s FROM s QUALIFY count(*) OVER (PARTITION BY array_to_string(w[s:s + 34], ' ')) > 1),
hit AS (SELECT DISTINCT doc_id, s + o AS i FROM r, range(35) t(o)),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT v.doc_id, count(hit.i) AS n, string_agg(word, ' ' ORDER BY v.i) FILTER (hit.i IS NULL) AS kept FROM v LEFT JOIN hit ON hit.doc_id = v.doc_id AND hit.i = v.i GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""

_PLAIN_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

BENCHMARK_HITS = f"""
WITH i0 AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN_WORDS.format(_lower("coalesce(text, '')"))} AS w FROM benchmark),
i1 AS (SELECT item, w, least(10, len(w)) AS n FROM i0 WHERE len(w) > 0),
i2 AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i1),
items AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM i2),
d AS (SELECT doc_id, {_PLAIN_WORDS.format(_lower("coalesce(text, '')"))} AS w FROM documents),
d2 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM items)),
m AS (SELECT doc_id, s, d2.n, item FROM d2 JOIN items ON items.n = d2.n AND items.k = array_to_string(w[s:s + d2.n - 1], ' ')),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id"""

COMMON_LINES = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM s),
k AS (SELECT *, {_lower(f"regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g')")} AS key FROM l),
n AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN n ON n.key = k.key GROUP BY doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_lower("coalesce(text, '')"))} AS w FROM documents),
x AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN range(1, least(len(w), 1) + 1) ELSE range(1, len(w) - 3) END) AS s, w FROM d),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM x),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON b.k = a.k AND b.doc_id > a.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN z y ON y.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * c >= 75 * (y.n + v.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(i, j) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.i, u.b FROM r JOIN u ON u.a = r.j)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN z ON z.doc_id = d.doc_id JOIN (SELECT i, min(j) AS component_id FROM r GROUP BY 1) c ON c.i = d.doc_id"""
