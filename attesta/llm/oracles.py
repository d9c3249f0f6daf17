"""DuckDB SQL for operators whose results SQL can state: by exact definition, without their methods."""

from __future__ import annotations

from .lines import SIZE
from .suffix import LENGTH

#: From links (x, y with x < y) over nodes (n): least(n, c), the least node reachable.
_CLOSURE = """
pairs2 AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(n, m) AS (SELECT n, n FROM nodes UNION SELECT r.n, b.y FROM reach r JOIN pairs2 b ON b.x = r.m WHERE b.y <> r.n),
heads AS (SELECT n, least(n, min(m)) AS c FROM reach GROUP BY n)"""

_WORDS = 3
OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {_WORDS} THEN list_transform(range(1, len(w) - {_WORDS - 2}), lambda i: array_to_string(w[i:i + {_WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
k AS (SELECT list_sort(s) AS s, min(doc_id) AS n, len(s) AS size FROM s WHERE len(s) > 0 GROUP BY 1, 3),
e AS (SELECT n, size, unnest(s) AS g FROM k), df AS (SELECT g, count(*) AS df FROM e GROUP BY 1),
f AS (SELECT e.n, e.size, g, row_number() OVER (PARTITION BY e.n ORDER BY df, g) AS i FROM e JOIN df USING (g)),
p AS (SELECT * FROM f WHERE i <= size - ceil(0.85 * size) + 1),
c AS (SELECT DISTINCT a.n AS x, b.n AS y FROM p a JOIN p b USING (g) WHERE a.n < b.n AND least(a.size, b.size) * 100 >= greatest(a.size, b.size) * 85),
links AS (SELECT x, y FROM c JOIN k a ON a.n = x JOIN k b ON b.n = y WHERE 100 * len(list_intersect(a.s, b.s)) >= 85 * (a.size + b.size - len(list_intersect(a.s, b.s)))),
nodes AS (SELECT n FROM k), {_CLOSURE}
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM s LEFT JOIN k ON k.s = list_sort(s.s) LEFT JOIN heads USING (n)"""

OP2_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no::INTEGER AS line_no, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM r WHERE trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS o FROM l),
d AS (SELECT line, min(o) AS n FROM o GROUP BY 1),
s AS (SELECT n, list_distinct(CASE WHEN length(line) > {SIZE} THEN list_transform(range(1, length(line) - {SIZE - 2}), lambda i: substr(line, i::INT, {SIZE})) ELSE [line] END) AS s FROM d),
e AS (SELECT n, len(s) AS size, unnest(s) AS g FROM s), df AS (SELECT g, count(*) AS df FROM e GROUP BY 1),
f AS (SELECT e.n, e.size, g, row_number() OVER (PARTITION BY e.n ORDER BY df, g) AS i FROM e JOIN df USING (g)),
p AS (SELECT * FROM f WHERE i <= size - ceil(0.8 * size) + 1),
c AS (SELECT DISTINCT a.n AS x, b.n AS y FROM p a JOIN p b USING (g) WHERE a.n < b.n AND least(a.size, b.size) * 100 >= greatest(a.size, b.size) * 80),
links AS (SELECT x, y FROM c JOIN s a ON a.n = x JOIN s b ON b.n = y WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
nodes AS (SELECT n FROM s), {_CLOSURE}
SELECT o.doc_id, o.line_no, h.doc_id AS component_doc_id, h.line_no AS component_line_no, h.o = o.o AS kept
FROM o JOIN d USING (line) JOIN heads ON heads.n = d.n JOIN o h ON h.o = heads.c"""

#: Texts as hexadecimal digits: two of them are a byte.
OP10_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - {LENGTH - 1})) AS p, x FROM t WHERE n >= {LENGTH}),
k AS (SELECT doc_id, p, md5(substr(x, (2 * p + 1)::INT, {2 * LENGTH})) AS k FROM w),
m AS (SELECT k, min(doc_id) AS least FROM k GROUP BY 1),
g AS (SELECT doc_id, p, coalesce(p > lag(p) OVER o + {LENGTH}, true) AS new FROM k JOIN m USING (k) WHERE doc_id > least WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, run, min(p) AS b, max(p) + {LENGTH} AS e FROM r GROUP BY 1, 2),
f AS (SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a, e FROM s),
j AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS spans, string_agg(substr(x, (2 * a + 1)::INT, (2 * (b - a))::INT), '' ORDER BY b) || substr(any_value(x), (2 * max(e) + 1)::INT) AS kept FROM f JOIN t USING (doc_id) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM t LEFT JOIN j USING (doc_id)"""
