"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .urls import RULES

_LOW = f"translate({{}}, '{UPPER}', '{LOWER}')"

_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
g AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
p AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT p.doc_id, p.k, p.i, g.item FROM p JOIN g ON p.k = g.k AND p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON a = d.doc_id
"""


def _rules(host: str, path: str, value: int) -> str:
    """CASE over the rules, the longest first; value 0 gives the verdict, 1 the rule."""
    cases = [
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(v, h + p)[value]}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    return "CASE " + " ".join(cases) + " END"


_HOST = _LOW.format("regexp_extract({}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")
_PATH = "regexp_extract({}, '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
_ADDRESS = _LOW.format("regexp_extract({0}, '(?s)^([^#]*?://[^/?#]*)', 1)") + " || substr(regexp_replace({0}, '(?s)#.*$', ''), length(regexp_extract({0}, '(?s)^([^#]*?://[^/?#]*)', 1)) + 1)"

URL_FILTERS = f"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
tag AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS t FROM p WHERE url <> ''),
raw AS (SELECT url, replace(CASE WHEN regexp_matches(t, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
   WHEN regexp_matches(t, '(?is)^<meta\\b.*http-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) ELSE '' END, '&amp;', '&') AS t FROM tag),
abs AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t
   WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t WHEN starts_with(t, '?') THEN regexp_extract(url, '(?s)^([^?#]*)', 1) || t
   ELSE regexp_extract(regexp_extract(url, '(?s)^([^?#]*)', 1), '(?s)^(.*/)', 1) || t END AS t FROM raw WHERE t <> ''),
l AS (SELECT {_ADDRESS.format("url")} AS x, {_ADDRESS.format("t")} AS y FROM abs),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT x, x FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
v AS (SELECT a, {_rules(_HOST.format("b"), _PATH.format("b"), 0)} AS said FROM r),
m AS (SELECT a, CASE WHEN bool_or(said = 'allow') THEN 'allow' WHEN bool_or(said = 'block') THEN 'block' END AS said FROM v GROUP BY a),
q AS (SELECT page_id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_ADDRESS.format("url")} AS node FROM p)
SELECT page_id, host, path, {_rules("host", "path", 1)} AS rule, coalesce({_rules("host", "path", 0)}, said, 'allow') AS verdict FROM q LEFT JOIN m ON a = node
"""
