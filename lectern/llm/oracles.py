"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD}')"


OP2 = f"""
WITH d AS (SELECT doc_id, source, len({words("coalesce(text, '')")})::BIGINT AS size, md5('mix-1:' || doc_id) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER ()::HUGEINT AS total,
        coalesce(sum(3 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS caps_before,
        sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weights_from
      FROM s WINDOW r AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
c AS (SELECT *, 3 * source_size::HUGEINT * weights_from < weight * (total - caps_before) AS capped FROM o),
t AS (SELECT any_value(total) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS remaining, sum(weight) FILTER (NOT capped) AS weights FROM c),
p AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * remaining::DOUBLE / weights::DOUBLE END AS target FROM c, t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, 3) ELSE 0 END AS whole FROM p),
u AS (SELECT *, round(target - whole * source_size)::BIGINT AS part FROM q),
r AS (SELECT doc_id, size, source_size, target, whole, part,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (size * whole + greatest(0, least(size, part - start)))::BIGINT AS taken FROM r
"""

OP6 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {lower(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, owner IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op8(at_least: int) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(lower("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {at_least} * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, b.b FROM r JOIN both_ways b ON b.a = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id, d.doc_id = min(r.c) AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""


#: The names of a site's own pages.
PAGE_NAMES = ", ".join(
    f"'{x}'"
    for x in "about account archive blog careers cart checkout contact download downloads events faq forum gallery help home login logout menu news press privacy products"
    " register search services shop sitemap support terms".split()
)

#: Quality rules of one line; expects ``line`` and its words ``ws``.
LINE_FAILS = rf"""
CASE WHEN len(ws) > 3 AND len(list_filter(ws, lambda x: x IN ('|', '>', '>>', '/', '\', '»', '›', '·', '•'))) > 0.2 * len(ws) THEN true
     WHEN len(ws) >= 15 AND len(list_filter(ws, lambda x: regexp_matches(x, '(\.|!|\?|:|;|"|''|\)|…|”|»|’|。|！|？)$'))) = 0 THEN true
     WHEN len(ws) > 2 AND len(list_filter(ws, lambda x: {lower("x")} IN ({PAGE_NAMES}))) >= 0.5 * len(ws) AND len(list_filter(ws, lambda x: regexp_matches(x, '(\.|!|\?|:|;|"|''|\)|…|”|»|’|。|！|？)$'))) = 0 THEN true
     WHEN len(ws) < 4 THEN false
     WHEN len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>]'))) >= 0.4 * len(ws) THEN true
     WHEN len(list_filter(ws, lambda x: suffix(x, '!!'))) >= 0.6 * len(ws) THEN true
     ELSE regexp_matches({lower("line")}, 'all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|javascript|lorem ipsum|sign up for|subscribe to our|click here|powered by') END
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, len({words("text")})::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
e AS (SELECT doc_id, line, i, {words("line")} AS ws,
             len(ws) <= 3 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]') AND NOT regexp_matches(x, '(\.|!|\?|:|;|"|''|\)|…|”|»|’|。|！|？)$'))) = len(ws) AS entry FROM l),
f AS (SELECT *, count(*) FILTER (NOT entry) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM e),
j AS (SELECT doc_id, line, ws, entry AND len(ws) > 0 AND count(*) FILTER (entry AND len(ws) > 0) OVER (PARTITION BY doc_id, block) >= 6 AS menu FROM f),
v AS (SELECT doc_id, coalesce((count(*) FILTER (len(ws) > 0) - count(DISTINCT line) FILTER (len(ws) > 0)), 0)::BIGINT AS n_dup_lines,
             coalesce(sum(len(ws)) FILTER (len(ws) > 0 AND (menu OR {LINE_FAILS})), 0) AS lost FROM j GROUP BY doc_id),
t AS (SELECT doc_id, unnest({words("text")}) AS w, generate_subscripts({words("text")}, 1) AS i FROM d),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM g),
h AS (SELECT doc_id, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM c),
n AS (SELECT doc_id, count(*) FILTER (hit)::BIGINT AS n_repeat_words FROM h GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND lost <= 0.5 * n_words AS kept
FROM b JOIN v USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _p(count: str, total: str, terms: str) -> str:
    return f"1 + 1000000000::HUGEINT * ({count} + 1) // ({total} + {terms})"


OP12 = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lower("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS doc FROM documents),
w AS (SELECT lang, source, doc, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS in_lang FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY 1, 2),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_p("coalesce(c.c, 0)", "coalesce(n.n, 0)", "l.v")} AS p, {_p("k.in_lang", "l.n", "l.v")} AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value FROM a x JOIN a y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
o AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM a WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


def _nearest(books: str) -> str:
    return f"""SELECT r, k, any_value(p.x) AS x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
      FROM (SELECT p.r, p.k, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN {books} b USING (k)) p GROUP BY r, k"""


def _replaced(books: str, assigned: str) -> str:
    floor_mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
    return f"""SELECT b.k, b.entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT k, entry, list({floor_mean} ORDER BY j) AS x
      FROM (SELECT k, entry, j, sum(x[j])::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT k, entry, x, unnest(range(1, len(x) + 1)) AS j FROM {assigned}) GROUP BY k, entry, j) GROUP BY k, entry) m USING (k, entry)"""


OP13 = f"""
WITH e AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS (SELECT r, k, x[k * (len(x) // 16) + 1:(k + 1) * (len(x) // 16)] AS x FROM e, (SELECT unnest(range(16)) AS k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS entry, x FROM p WHERE r <= 64),
a0 AS MATERIALIZED ({_nearest("b0")}),
b1 AS MATERIALIZED ({_replaced("b0", "a0")}),
a1 AS MATERIALIZED ({_nearest("b1")}),
b2 AS MATERIALIZED ({_replaced("b1", "a1")}),
a2 AS MATERIALIZED ({_nearest("b2")}),
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN c USING (r), h
"""
