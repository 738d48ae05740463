"""DuckDB SQL for the ``opN_<name>`` queries that SQL can express."""

from __future__ import annotations

from . import chat_format as chat
from . import divergence_audit as audit
from . import scaled_sketch as sketch
from . import treap_search as lexical
from . import url_filter as url
from .topk_search import SCALE, TOP

CHAT = f"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) AS turns, count(*) AS n,
    string_agg('{chat.OPEN}' || role || '{chat.MIDDLE}' || text || '{chat.CLOSE}', '' ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id),
alone AS (SELECT turns, n, rendered, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY turns, n, rendered)
SELECT conv_id, n AS n_turns, copies AS n_copies, length(rendered) AS n_chars, sha256(rendered) AS rendered_sha256
FROM alone a
WHERE NOT EXISTS (SELECT 1 FROM alone b WHERE b.n > a.n AND b.turns[1:a.n] = a.turns)
""".replace("\\n", "\n")

TOPK = f"""
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * {SCALE}) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= {TOP}
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id, vec_id AS id FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.id = links.a),
c AS (SELECT vec_id, min(id) AS id FROM reach GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.id, e.vec_id) AS component_id, e.vec_id = coalesce(c.id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""

NEAR_TEXTS = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS id FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.id = links.a),
c AS (SELECT doc_id, min(id) AS id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.id, d.doc_id) AS component_id, d.doc_id = coalesce(c.id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

#: A-Z of a text in lower case.
LOWERED = f"translate(coalesce(text, ''), '{sketch.UPPER}', '{sketch.LOWER}')"

LEXICAL = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d),
i AS (
  SELECT item_id, term, count(*) AS c
  FROM (SELECT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, docs),
s AS (
  SELECT item_id, f.doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN d ON d.doc_id = f.doc_id, a GROUP BY item_id, f.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {lexical.TOP}
"""

_HASHES = lambda t: f"list_transform(range(1, greatest(len({t}) - {sketch.WORDS - 2}, 2)), lambda i: left(md5(array_to_string({t}[i:i + {sketch.WORDS - 1}], ' ')), {sketch.DIGITS}))"
_WORDS = lambda t: rf"regexp_extract_all(translate({t}, '{sketch.UPPER}', '{sketch.LOWER}'), '[^{sketch.SPACE}]+')"
_KEPT = lambda h: f"list_sort(list_distinct(list_filter({h}, lambda x: x < '{sketch.below()}')))"
_LIKE = lambda a, b: f"""CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) WHEN len({a}) = len({b}) THEN 1.0::DOUBLE ELSE 0.0 END"""

FINGERPRINT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id) AS at, count(*) OVER () AS all_n FROM documents),
e AS (
  SELECT d.doc_id, d.n, d.text, x.text AS next, substring(d.text, 1, d.n - d.n // {sketch.EDIT}) || substring(x.text, 1, d.n // {sketch.EDIT}) AS edited
  FROM d JOIN d x ON x.at = d.at % d.all_n + 1),
w AS (SELECT *, {_WORDS('text')} AS w1, {_WORDS('edited')} AS w2, {_WORDS('next')} AS w3 FROM e),
h AS (SELECT *, {', '.join(f"CASE WHEN len(w{k}) > 0 THEN {_HASHES(f'w{k}')} ELSE [] END AS h{k}" for k in (1, 2, 3))} FROM w),
s AS (SELECT *, {', '.join(f"CASE WHEN len(h{k}) > 0 AND list_min(h{k}) >= '{sketch.below()}' THEN [list_min(h{k})] ELSE {_KEPT(f'h{k}')} END AS s{k}" for k in (1, 2, 3))} FROM h)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(s1, ',') AS fingerprint, array_to_string(s2, ',') AS edited_fingerprint,
  {_LIKE('s1', 's2')} AS near_edited, {_LIKE('s1', 's3')} AS near_next
FROM s
"""

_SHARE = lambda n, total, v: f"1 + ({audit.FINE}::HUGEINT * ({n} + 2)) // ({total} + 2 * {v})"
AUDIT = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWERED} AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {audit.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, sum(total)::BIGINT AS total FROM g GROUP BY lang),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {_SHARE('coalesce(c.n, 0)', 'g.total', 'v.v')} AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
q AS (SELECT c.lang, c.term, {_SHARE('sum(n)::BIGINT', 'l.total', 'v.v')} AS q FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY c.lang, c.term, l.total, v.v),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {audit.TOP_TERMS}
"""


#: Rounds after which no mass moves on the test tables: the operator stops there by itself.
RESTED = 150


def url_sql(rules=url.RULES, turns: int = RESTED) -> str:
    order = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in order]
    case = lambda values: "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values)) + " END"
    host = lambda u: f"translate(regexp_extract({u}, '^[^/?#]*'), '{url.UPPER}', '{url.LOWER}')"
    steps = "".join(f"""
s{i} AS MATERIALIZED (SELECT kind, host, sum(part)::HUGEINT AS mass FROM (
  SELECT s.kind, e.dst AS host, (s.mass * {url.FOLLOW} // 100) * e.w // e.o AS part FROM s{i - 1} s JOIN shares e ON e.kind = s.kind AND e.host = s.host
  UNION ALL SELECT kind, host, part FROM home) GROUP BY kind, host),""" for i in range(1, turns + 1))  # fmt: skip
    return f"""
WITH r AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, {host('rest')} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
j AS MATERIALIZED (SELECT page_id, html, host, path, {case([h + p for _, h, p in order])} AS rule, {case([v for v, _, _ in order])} AS judged FROM h),
links AS (
  SELECT src, dst, count(*) AS w FROM (
    SELECT host AS src, {host("substr(u, strpos(u, '://') + 3)")} AS dst FROM (
      SELECT host, unnest(regexp_extract_all(html, '(?is)href\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^"''\\s>]+)', 1)) AS u FROM j))
  WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
hosts AS (SELECT host FROM j UNION SELECT dst FROM links),
labels AS (SELECT string_split(host, '.') AS l FROM hosts WHERE len(string_split(host, '.')) > 2),
up AS (
  SELECT DISTINCT array_to_string(l[k:], '.') AS src, array_to_string(l[k + 1:], '.') AS dst
  FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM labels)),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY src, dst),
way AS (SELECT 'trust' AS kind, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
shares AS MATERIALIZED (
  SELECT kind, src AS host, dst, w::HUGEINT AS w, (sum(w) OVER (PARTITION BY kind, src))::HUGEINT AS o FROM way),
seeds AS (SELECT CASE judged WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM j WHERE judged IS NOT NULL GROUP BY ALL),
whole_mass AS MATERIALIZED (SELECT least({url.MOST}::HUGEINT, {url.UNIT}::HUGEINT * (SELECT coalesce(sum(w), 0) FROM (SELECT w FROM edges UNION ALL SELECT n FROM seeds))::HUGEINT) AS fine),
home AS MATERIALIZED (SELECT kind, host, fine * n // (sum(n) OVER (PARTITION BY kind))::HUGEINT * {100 - url.FOLLOW} // 100 AS part FROM seeds, whole_mass),
s0 AS MATERIALIZED (SELECT kind, host, part AS mass FROM home),{steps}
whole AS MATERIALIZED (SELECT kind, host, mass * {url.FINE}::HUGEINT // (sum(mass) OVER (PARTITION BY kind))::HUGEINT AS mass FROM s{turns}),
m AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS d FROM whole GROUP BY host),
x AS (SELECT host, CAST(CASE WHEN t + d > 0 THEN 100 * d // (t + d) ELSE 0 END AS BIGINT) AS share FROM m)
SELECT page_id, j.host, path, rule, coalesce(judged, CASE WHEN x.share >= {url.SHARE} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(x.share, 0) AS distrust_share
FROM j LEFT JOIN x ON x.host = j.host
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dup": NEAR_VECTORS, "op4_topk_search": TOPK, "op7_chat_format": CHAT,
        "op8_url_filter": url_sql(), "op10_minhash_near_dup": NEAR_TEXTS,
        "op11_treap_search": LEXICAL, "op12_scaled_fingerprint": FINGERPRINT, "op13_divergence_audit": AUDIT,
    }
