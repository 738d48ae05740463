"""DuckDB SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

from ..operators.epidemic import FACTORS, OFFSETS, PRIME
from .queries import BETA, DIGITS, PROBABILITY, RANKING, RANKINGS, RUNS

COSOURCE = """
bought AS MATERIALIZED (SELECT DISTINCT o_custkey AS c, l_partkey AS p, l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS MATERIALIZED (SELECT DISTINCT a.c AS src, b.c AS dst FROM bought a JOIN bought b ON a.p = b.p AND a.s = b.s AND a.c < b.c),
nodes AS MATERIALIZED (SELECT c_custkey AS node_id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS group_id FROM customer),
adj AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""

COMOMENT = """
active AS MATERIALIZED (SELECT DISTINCT user_id AS u, date_trunc('minute', ts) AS m FROM events WHERE user_id IS NOT NULL),
edges AS MATERIALIZED (SELECT DISTINCT a.u AS src, b.u AS dst FROM active a JOIN active b ON a.m = b.m AND a.u < b.u),
nodes AS MATERIALIZED (SELECT DISTINCT u AS node_id, CAST(u % 5 AS INTEGER) AS group_id FROM active),
adj AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""

NATIONS = """
traded AS MATERIALIZED (
  SELECT least(c_nationkey, s_nationkey)::BIGINT AS src, greatest(c_nationkey, s_nationkey)::BIGINT AS dst, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edges AS MATERIALIZED (SELECT src, dst FROM traded WHERE w > (SELECT avg(w) FROM traded)),
nodes AS MATERIALIZED (SELECT n_nationkey::BIGINT AS node_id, n_regionkey AS group_id FROM nation),
adj AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""

DEGREE = "deg AS MATERIALIZED (SELECT node_id, count(dst) AS value FROM nodes LEFT JOIN adj ON src = node_id GROUP BY node_id)"


def q(*parts: str, recursive: bool = False) -> str:
    *ctes, final = parts
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + final


def ranked(table: str, value: str = "value", kind: str = "dense_rank") -> str:
    return f"SELECT node_id, {value} AS value, CAST({kind}() OVER (ORDER BY {value} DESC) AS INTEGER) AS rank FROM {table}"


def scored(table: str) -> str:
    return ranked(f"(SELECT node_id, round(value, {DIGITS}) AS value FROM {table})")


def vector(ranking=RANKING, name: str = "vec") -> str:
    """Degree vectors: neighbours per ranked group, and oneself in one's own."""
    parts = ", ".join(f"count(*) FILTER (g.group_id = {r}) + CASE WHEN any_value(n.group_id) = {r} THEN 1 ELSE 0 END" for r in ranking)
    return f"{name} AS MATERIALIZED (SELECT n.node_id, [{parts}] AS v FROM nodes n LEFT JOIN adj ON src = n.node_id LEFT JOIN nodes g ON g.node_id = dst GROUP BY n.node_id)"


def rendered(table: str, vec: str = "v") -> str:
    return f"SELECT node_id, array_to_string({vec}, '_') AS value, CAST(dense_rank() OVER (ORDER BY {vec} DESC) AS INTEGER) AS rank FROM {table}"


def h_step(new: str, old: str) -> str:
    return f"""{new} AS MATERIALIZED (
  SELECT n.node_id, coalesce(max(h), 0)::BIGINT AS value FROM nodes n LEFT JOIN (
    SELECT src, least(value, row_number() OVER (PARTITION BY src ORDER BY value DESC)) AS h FROM adj JOIN {old} ON dst = node_id) x ON x.src = n.node_id GROUP BY n.node_id)"""


def h_chain(k: int) -> list[str]:
    return [DEGREE, *[h_step(f"h{i}", "deg" if i == 1 else f"h{i - 1}") for i in range(1, k + 1)]]


#: Rounds after which the unrolled chains have settled on the test tables.
CORE_ROUNDS = 40
CORES = [*h_chain(CORE_ROUNDS), f"core AS (SELECT * FROM h{CORE_ROUNDS})"]


def peel(rounds: int, ranking=RANKING) -> list[str]:
    """The lexicographic h-index, unrolled."""
    s = range(len(ranking))
    own = ", ".join(f"CASE WHEN group_id = {r} THEN 1 ELSE 0 END AS o{i}" for i, r in enumerate(ranking))
    out = [f"mine AS MATERIALIZED (SELECT node_id, {own} FROM nodes)", vector(ranking, "p0")]
    cum = ", ".join(f"sum(n.o{i}) OVER w AS c{i}" for i in s)
    cand = ", ".join(f"(c{i} + m.o{i})::BIGINT" for i in s)
    me = ", ".join(f"o{i}::BIGINT" for i in s)
    for k in range(1, rounds + 1):
        out.append(f"""p{k} AS MATERIALIZED (
  SELECT p.node_id, CASE WHEN b.best IS NULL OR b.best < [{me}] THEN [{me}] ELSE b.best END AS v
  FROM p{k - 1} p JOIN mine USING (node_id) LEFT JOIN (
    SELECT src, max(CASE WHEN v < c THEN v ELSE c END) AS best FROM (
      SELECT x.src, x.v, [{cand}] AS c FROM (
        SELECT a.src, q.v, {cum} FROM adj a JOIN p{k - 1} q ON q.node_id = a.dst JOIN mine n ON n.node_id = a.dst
        WINDOW w AS (PARTITION BY a.src ORDER BY q.v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x
      JOIN mine m ON m.node_id = x.src) GROUP BY src) b ON b.src = p.node_id)""")
    return [*out, f"peeled AS (SELECT * FROM p{rounds})"]


NEAR = """
d1 AS MATERIALIZED (SELECT src, dst, 1 AS d FROM adj),
d2 AS MATERIALIZED (SELECT DISTINCT a.src, b.dst, 2 AS d FROM d1 a JOIN adj b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.src = a.src AND x.dst = b.dst)),
d3 AS MATERIALIZED (
  SELECT DISTINCT a.src, b.dst, 3 AS d FROM d2 a JOIN adj b ON a.dst = b.src WHERE a.src <> b.dst
    AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.src = a.src AND x.dst = b.dst) AND NOT EXISTS (SELECT 1 FROM d2 x WHERE x.src = a.src AND x.dst = b.dst)),
near AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3)"""

FAR = """
walk AS (SELECT src, dst, 1 AS d FROM adj UNION SELECT w.src, a.dst, w.d + 1 FROM walk w JOIN adj a ON w.dst = a.src WHERE w.d < 24 AND a.dst <> w.src),
far AS MATERIALIZED (SELECT src, dst, min(d) AS d FROM walk GROUP BY src, dst)"""


def gravity(mass: str, name: str = "grav") -> str:
    """Whole sums in 36ths (squared distances are 1, 4 and 9), so ties do not depend on the order of adding."""
    return f"""{name}36 AS MATERIALIZED (
  SELECT n.node_id, CAST(max(m.value) AS BIGINT) * coalesce(sum(CAST(o.value AS BIGINT) * (36 // (d * d))), 0)::BIGINT AS value FROM nodes n JOIN {mass} m ON m.node_id = n.node_id
  LEFT JOIN near ON near.src = n.node_id LEFT JOIN {mass} o ON o.node_id = near.dst GROUP BY n.node_id),
{name} AS MATERIALIZED (SELECT node_id, value::DOUBLE / 36 AS value FROM {name}36)"""


TRIANGLES = "tri AS MATERIALIZED (SELECT a.src AS u, a.dst AS v, b.dst AS w FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst)"
PER_NODE = "tn AS MATERIALIZED (SELECT node_id, count(*) AS t FROM (SELECT unnest([u, v, w]) AS node_id FROM tri) GROUP BY node_id)"


def pagerank(rounds: int, jump: str) -> list[str]:
    """``jump``: an expression over a node's group_id."""
    out = [DEGREE, f"base AS MATERIALIZED (SELECT node_id, j / sum(j) OVER () AS p, value AS deg FROM (SELECT node_id, ({jump})::DOUBLE AS j FROM nodes) JOIN deg USING (node_id))", "r0 AS MATERIALIZED (SELECT node_id, p AS value FROM base)"]
    for k in range(1, rounds + 1):
        out.append(f"""r{k} AS MATERIALIZED (
  SELECT b.node_id, 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(value), 0) FROM r{k - 1} JOIN base USING (node_id) WHERE deg = 0) * b.p) + (1 - 0.85::DOUBLE) * b.p AS value
  FROM base b LEFT JOIN (SELECT a.dst AS node_id, sum(r.value / c.deg) AS got FROM adj a JOIN r{k - 1} r ON r.node_id = a.src JOIN base c ON c.node_id = a.src GROUP BY a.dst) g USING (node_id))""")
    return [*out, f"pr AS (SELECT * FROM r{rounds})"]


def shares(ranking=RANKING) -> str:
    w = " ".join(f"WHEN {g} THEN {0.5**i}" for i, g in enumerate(ranking))
    return f"phi AS MATERIALIZED (SELECT group_id, w / sum(w) OVER () AS share FROM (SELECT group_id, (CASE group_id {w} ELSE {0.5 ** (len(ranking) + 1)} END)::DOUBLE AS w FROM (SELECT DISTINCT group_id FROM nodes)))"


FAIR_BASE = "base AS MATERIALIZED (SELECT n.node_id, n.group_id, share / size AS jump FROM nodes n JOIN (SELECT group_id, count(*) AS size FROM nodes GROUP BY group_id) USING (group_id) JOIN phi USING (group_id))"


def lfpr_n(rounds: int) -> list[str]:
    out = [shares(), FAIR_BASE, "cnt AS MATERIALIZED (SELECT src, group_id, count(*) AS k FROM adj JOIN nodes ON node_id = dst GROUP BY src, group_id)",
           "dealt AS MATERIALIZED (SELECT a.src, a.dst, share / k AS weight FROM adj a JOIN nodes n ON n.node_id = a.dst JOIN cnt c ON c.src = a.src AND c.group_id = n.group_id JOIN phi ON phi.group_id = n.group_id)",
           "lacks AS MATERIALIZED (SELECT node_id, phi.group_id, share FROM nodes n CROSS JOIN phi WHERE NOT EXISTS (SELECT 1 FROM cnt WHERE cnt.src = n.node_id AND cnt.group_id = phi.group_id))",
           "f0 AS MATERIALIZED (SELECT node_id, jump AS value FROM base)"]
    for k in range(1, rounds + 1):
        out.append(f"""g{k} AS MATERIALIZED (
  SELECT b.node_id, b.jump, 0.85::DOUBLE * (coalesce(x.direct, 0) + coalesce(y.bucket, 0) / z.size) AS got FROM base b
  LEFT JOIN (SELECT dst AS node_id, sum(f.value * weight) AS direct FROM dealt JOIN f{k - 1} f ON f.node_id = src GROUP BY dst) x USING (node_id)
  LEFT JOIN (SELECT group_id, sum(f.value * share) AS bucket FROM lacks JOIN f{k - 1} f USING (node_id) GROUP BY group_id) y USING (group_id)
  JOIN (SELECT group_id, count(*) AS size FROM nodes GROUP BY group_id) z USING (group_id)),
f{k} AS MATERIALIZED (SELECT node_id, got + (1 - (SELECT sum(got) FROM g{k})) * jump AS value FROM g{k})""")
    return [*out, f"fair AS (SELECT * FROM f{rounds})"]


def lfpr_u(rounds: int) -> list[str]:
    out = ["two AS MATERIALIZED (SELECT node_id, group_id % 2 AS group_id FROM nodes)",
           "size2 AS MATERIALIZED (SELECT group_id, count(*) AS size FROM two GROUP BY group_id)",
           "base AS MATERIALIZED (SELECT node_id, group_id, size, 0.5::DOUBLE / size AS jump FROM two JOIN size2 USING (group_id))",
           "k2 AS MATERIALIZED (SELECT t.node_id, count(*) FILTER (g.group_id = 1) AS k1, count(*) FILTER (g.group_id = 0) AS k0 FROM two t LEFT JOIN adj ON src = t.node_id LEFT JOIN two g ON g.node_id = dst GROUP BY t.node_id)",
           "x2 AS MATERIALIZED (SELECT node_id, x, 0.5::DOUBLE - x * k1 AS e1, 0.5::DOUBLE - x * k0 AS e0 FROM (SELECT *, coalesce(least(CASE WHEN k1 > 0 THEN 0.5::DOUBLE / k1 END, CASE WHEN k0 > 0 THEN 0.5::DOUBLE / k0 END), 0) AS x FROM k2))",
           "f0 AS MATERIALIZED (SELECT node_id, jump AS value FROM base)"]
    for k in range(1, rounds + 1):
        out.append(f"""g{k} AS MATERIALIZED (
  SELECT b.node_id, b.jump, 0.85::DOUBLE * (coalesce(d.direct, 0) + CASE WHEN b.group_id = 1 THEN (SELECT sum(value * e1) FROM f{k - 1} JOIN x2 USING (node_id)) ELSE (SELECT sum(value * e0) FROM f{k - 1} JOIN x2 USING (node_id)) END / b.size) AS got FROM base b
  LEFT JOIN (SELECT dst AS node_id, sum(f.value * x) AS direct FROM adj JOIN f{k - 1} f ON f.node_id = src JOIN x2 ON x2.node_id = src GROUP BY dst) d USING (node_id)),
f{k} AS MATERIALIZED (SELECT node_id, got + (1 - (SELECT sum(got) FROM g{k})) * jump AS value FROM g{k})""")
    return [*out, f"fair AS (SELECT * FROM f{rounds})"]


#: How buckets are spread in the step rule: by plain PageRank.
BY_RANK = "pr.value / sum(pr.value) OVER (PARTITION BY t.group_id)"


def lfpr_p(rounds: int, spread: str = BY_RANK, more: list[str] = ()) -> list[str]:
    """The step rule of two groups with buckets spread by ``spread``, over plain PageRank of as many rounds."""
    step = lfpr_u(0)
    out = [*pagerank(rounds, "1"), step[0], step[1], *more,
           f"bs AS MATERIALIZED (SELECT t.node_id, t.group_id, 0.5::DOUBLE / size AS jump, {spread} AS s FROM two t JOIN size2 USING (group_id) JOIN pr USING (node_id))",
           step[3], step[4], "f0 AS MATERIALIZED (SELECT node_id, jump AS value FROM bs)"]
    for k in range(1, rounds + 1):
        out.append(f"""g{k} AS MATERIALIZED (
  SELECT b.node_id, b.jump, 0.85::DOUBLE * (coalesce(d.direct, 0) + b.s * CASE WHEN b.group_id = 1 THEN (SELECT sum(value * e1) FROM f{k - 1} JOIN x2 USING (node_id)) ELSE (SELECT sum(value * e0) FROM f{k - 1} JOIN x2 USING (node_id)) END) AS got FROM bs b
  LEFT JOIN (SELECT dst AS node_id, sum(f.value * x) AS direct FROM adj JOIN f{k - 1} f ON f.node_id = src JOIN x2 ON x2.node_id = src GROUP BY dst) d USING (node_id)),
f{k} AS MATERIALIZED (SELECT node_id, got + (1 - (SELECT sum(got) FROM g{k})) * jump AS value FROM g{k})""")
    return [*out, f"fair AS (SELECT * FROM f{rounds})"]


def hybrid_top(rounds: int, k: int) -> list[str]:
    """Buckets of the group furthest below its share go to its k nodes of most PageRank only."""
    more = ["gm2 AS (SELECT t.group_id, sum(pr.value) AS mass FROM two t JOIN pr USING (node_id) GROUP BY t.group_id)",
            "short AS MATERIALIZED (SELECT group_id FROM gm2 ORDER BY 0.5::DOUBLE - mass DESC, group_id DESC LIMIT 1)",
            f"""chosen AS MATERIALIZED (SELECT node_id FROM two WHERE group_id <> (SELECT group_id FROM short) UNION ALL
  SELECT node_id FROM (SELECT node_id, row_number() OVER (ORDER BY pr.value DESC, node_id) AS r FROM two t JOIN pr USING (node_id) WHERE t.group_id = (SELECT group_id FROM short)) WHERE r <= {k})"""]  # fmt: skip
    taken = "(t.node_id IN (SELECT node_id FROM chosen))::INTEGER"
    return lfpr_p(rounds, f"{taken} / (sum({taken}) OVER (PARTITION BY t.group_id))::DOUBLE", more)


def target_fair(rounds: int, k: int, near: bool) -> list[str]:
    """Fairness of two groups among the k nodes of most PageRank, the rest to the other group's targets."""
    own = "CASE WHEN likes = 0 THEN h1 ELSE h0 END"
    keep = f"AND {own} = 0" if near else ""
    extra = f" + CASE WHEN h.g = 1 - o.likes AND ({own}) > 0 THEN o.rest / ({own}) ELSE 0 END" if near else ""
    out = [*pagerank(rounds, "1"), "two AS MATERIALIZED (SELECT node_id, group_id % 2 AS group_id FROM nodes)",
           f"hit AS MATERIALIZED (SELECT t.node_id, t.group_id AS g, count(*) OVER (PARTITION BY t.group_id) AS size FROM two t JOIN (SELECT node_id FROM pr ORDER BY value DESC, node_id LIMIT {k}) USING (node_id))",
           "oa AS (SELECT src, count(*) AS d, count(*) FILTER (g = 0) AS h0, count(*) FILTER (g = 1) AS h1 FROM adj LEFT JOIN hit ON hit.node_id = dst GROUP BY src)",
           "ob AS (SELECT *, CASE WHEN h0 + h1 > 0 THEN CASE WHEN h0 / (h0 + h1)::DOUBLE >= 0.5 THEN 0 ELSE 1 END END AS likes FROM oa)",
           "oc AS (SELECT *, CASE likes WHEN 0 THEN (h0 + h1) / d::DOUBLE * (0.5::DOUBLE / h0) WHEN 1 THEN (h0 + h1) / d::DOUBLE * (0.5::DOUBLE / h1) ELSE 0 END AS x FROM ob)",
           "od AS MATERIALIZED (SELECT *, (h0 + h1) / d::DOUBLE - x * (h0 + h1) AS rest FROM oc)",
           f"dealt AS MATERIALIZED (SELECT a.src, a.dst, CASE WHEN h.g IS NULL THEN 1 / o.d::DOUBLE ELSE o.x{extra} END AS w FROM adj a JOIN od o ON o.src = a.src LEFT JOIN hit h ON h.node_id = a.dst)",
           f"owed AS MATERIALIZED (SELECT src, 1 - likes AS g, rest FROM od WHERE likes IS NOT NULL AND rest <> 0 {keep})",
           f"bt AS MATERIALIZED (SELECT t.node_id, t.group_id, coalesce(1.0::DOUBLE / h.size, 0) AS s, coalesce({k} / (SELECT count(*) FROM nodes)::DOUBLE * 0.5::DOUBLE / h.size, 1.0::DOUBLE / (SELECT count(*) FROM nodes)) AS jump FROM two t LEFT JOIN hit h USING (node_id))",
           "f0 AS MATERIALIZED (SELECT node_id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS value FROM nodes)"]
    for r in range(1, rounds + 1):
        out.append(f"""g{r} AS MATERIALIZED (
  SELECT b.node_id, b.jump, 0.85::DOUBLE * (coalesce(d.direct, 0) + coalesce(y.bucket, 0) * b.s) AS got FROM bt b
  LEFT JOIN (SELECT dst AS node_id, sum(f.value * w) AS direct FROM dealt JOIN f{r - 1} f ON f.node_id = src GROUP BY dst) d USING (node_id)
  LEFT JOIN (SELECT g AS group_id, sum(f.value * rest) AS bucket FROM owed JOIN f{r - 1} f ON f.node_id = src GROUP BY g) y ON y.group_id = b.group_id),
f{r} AS MATERIALIZED (SELECT node_id, got + (1 - (SELECT sum(got) FROM g{r})) * jump AS value FROM g{r})""")
    return [*out, f"fair AS (SELECT * FROM f{rounds})"]


def spread(rounds: int = 25, probability: float = PROBABILITY, tag: str = "") -> list[str]:
    """SIR rounds, unrolled: a path visits each of the 25 nations once at most. ``tag`` ends the tables' names."""
    h = f"((src * {FACTORS['u']} + dst * {FACTORS['v']} + seed * {FACTORS['seed']} + sim * {FACTORS['sim']} + 17) % {PRIME})"
    t, v, cnt = f"t{tag}", f"v{tag}", f"cnt{tag}"
    out = [f"{t}0 AS MATERIALIZED (SELECT node_id AS seed, sim, node_id FROM nodes CROSS JOIN (SELECT unnest(range({RUNS})) AS sim))", f"{v}0 AS (SELECT * FROM {t}0)"]
    for k in range(1, rounds + 1):
        coin = "h0"
        inner = f"SELECT t.seed, t.sim, a.dst, {h} AS h0 FROM {t}{k - 1} t JOIN adj a ON a.src = t.node_id"
        for i, c in enumerate(OFFSETS):
            inner = f"SELECT seed, sim, dst, (h{i} * h{i} + {c} * (h{i} % 65536) + {c}) % {PRIME} AS h{i + 1} FROM ({inner})"
            coin = f"h{i + 1}"
        out.append(f"{t}{k} AS MATERIALIZED (SELECT DISTINCT seed, sim, dst AS node_id FROM ({inner}) x WHERE {coin} < {int(probability * PRIME)} AND NOT EXISTS (SELECT 1 FROM {v}{k - 1} v WHERE v.seed = x.seed AND v.sim = x.sim AND v.node_id = x.dst))")
        out.append(f"{v}{k} AS MATERIALIZED (SELECT * FROM {v}{k - 1} UNION ALL SELECT * FROM {t}{k})")
    out.append(f"{cnt} AS (SELECT seed, sim, group_id, count(*) AS c FROM {v}{rounds} JOIN nodes USING (node_id) GROUP BY ALL)")
    out.append(f"""sir{tag} AS MATERIALIZED (
  SELECT g.seed AS node_id, g.group_id, coalesce(s, 0) / {float(RUNS)}::DOUBLE AS mean,
    sqrt(greatest(coalesce(s2, 0) / {float(RUNS)}::DOUBLE - (coalesce(s, 0) / {float(RUNS)}::DOUBLE) * (coalesce(s, 0) / {float(RUNS)}::DOUBLE), 0)) AS std
  FROM (SELECT n.node_id AS seed, g.group_id FROM nodes n CROSS JOIN (SELECT DISTINCT group_id FROM nodes) g) g
  LEFT JOIN (SELECT seed, group_id, sum(c) AS s, sum(c * c) AS s2 FROM {cnt} GROUP BY seed, group_id) c ON c.seed = g.seed AND c.group_id = g.group_id)""")
    return out


def truth(ranking, name: str) -> str:
    vec = ", ".join(f"coalesce(max(mean) FILTER (group_id = {g}), 0.0)" for g in ranking)
    return f"{name} AS MATERIALIZED (SELECT node_id, [{vec}] AS v, CAST(rank() OVER (ORDER BY [{vec}] DESC) AS INTEGER) AS rank FROM sir GROUP BY node_id)"


def pairs() -> list[str]:
    out = [NATIONS, *h_chain(1), *spread()]
    rows = []
    for i, r in enumerate(RANKINGS):
        out += [truth(r, f"truth{i}"), vector(r, f"vec{i}")]
        key = "_".join(map(str, r))
        for name, table, value in (("degree", "deg", "value"), ("h1_index", "h1", "value"), ("degree_lexicographic", f"vec{i}", "v")):
            rows.append(f"SELECT '{key}' AS ranking, '{name}' AS method, x.node_id, CAST(dense_rank() OVER (ORDER BY x.{value} DESC) AS INTEGER) AS m, t.rank AS s FROM {table} x JOIN truth{i} t USING (node_id)")
    return [*out, "pairs AS MATERIALIZED (" + "\nUNION ALL ".join(rows) + ")"]


def metrics() -> list[str]:
    cols = []
    for name, k in (("at_1", "least(1, n)"), ("at_5", "least(5, n)"), ("pct_10", "greatest(1, floor(n * 10 / 100.0)::BIGINT)")):
        cols.append(f"least(count(*) FILTER (m <= {k} AND s <= {k}), max({k}))::DOUBLE / max({k}) AS precision_{name}")
        cols.append(f"avg(1.0::DOUBLE / m) FILTER (s <= {k}) AS arhr_{name}")
    return [*pairs(), f"metrics AS MATERIALIZED (SELECT ranking, method, max(n) AS num_common_nodes, count(*) FILTER (s = 1) AS num_truth_top1, avg(1.0::DOUBLE / m) FILTER (s = 1) AS mrr, {', '.join(cols)} FROM (SELECT *, count(*) OVER (PARTITION BY ranking, method) AS n FROM pairs) GROUP BY ranking, method)"]


R = lambda *names: ", ".join(f"round({n}, {DIGITS}) AS {n}" for n in names)
RESTRICT = "SELECT d.node_id, value, CAST(rank() OVER (ORDER BY CASE WHEN group_id IN ({}) THEN 0 ELSE 1 END, r) AS INTEGER) AS rank FROM (SELECT *, dense_rank() OVER (ORDER BY value DESC) AS r FROM deg) d JOIN nodes USING (node_id)"
THRESHOLD = "th AS (SELECT avg(value)::DOUBLE AS mean_degree, avg(value * value)::DOUBLE AS mean_squared_degree FROM deg), th2 AS (SELECT *, CASE WHEN mean_squared_degree > mean_degree THEN mean_degree / (mean_squared_degree - mean_degree) END AS threshold FROM th)"
GROUPS = "gm AS MATERIALIZED (SELECT group_id, count(*)::DOUBLE AS size, " + f"round(avg(c.value), {DIGITS}) AS coreness, round(avg(d.value), {DIGITS}) AS degree FROM nodes n JOIN core c ON c.node_id = n.node_id JOIN deg d ON d.node_id = n.node_id GROUP BY group_id)"
STRATEGIES = """
SELECT kind || '_' || metric AS strategy, length, string_agg(group_id::VARCHAR, '_' ORDER BY k) AS ranking FROM (
  SELECT metric, group_id, length, k, kind FROM (
    SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, group_id) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM (
      SELECT group_id, 'size' AS metric, size AS v FROM gm UNION ALL SELECT group_id, 'coreness', coreness FROM gm UNION ALL SELECT group_id, 'degree', degree FROM gm)) o
  CROSS JOIN (SELECT unnest([2, 3]) AS length) l
  CROSS JOIN LATERAL (
    SELECT 'top' AS kind, rn AS k WHERE rn <= length UNION ALL SELECT 'bottom', rn WHERE rn > n - length
    UNION ALL SELECT 'alt', CASE WHEN rn * 2 <= n + 1 THEN 2 * rn - 1 ELSE 2 * (n - rn + 1) END WHERE CASE WHEN rn * 2 <= n + 1 THEN 2 * rn - 1 ELSE 2 * (n - rn + 1) END <= length) x)
GROUP BY kind, metric, length"""
COMPONENT = "reach AS (SELECT node_id, node_id AS id FROM nodes UNION SELECT r.node_id, a.dst FROM reach r JOIN adj a ON a.src = r.id), comp AS MATERIALIZED (SELECT node_id, min(id) AS component FROM reach GROUP BY node_id)"
BETWEEN = """
sp0 AS MATERIALIZED (SELECT src, dst, d FROM far UNION ALL SELECT node_id, node_id, 0 FROM nodes),
sig AS (SELECT node_id AS src, node_id AS dst, 0 AS d, 1::DOUBLE AS n FROM nodes
  UNION ALL SELECT s.src, a.dst, s.d + 1, sum(s.n) FROM sig s JOIN adj a ON a.src = s.dst JOIN far f ON f.src = s.src AND f.dst = a.dst AND f.d = s.d + 1 GROUP BY s.src, a.dst, s.d + 1),
sn AS MATERIALIZED (SELECT src, dst, d, n FROM sig),
bt AS (
  SELECT a.dst AS node_id, sum(a.n * b.n / c.n) AS value FROM sn a JOIN sn b ON b.src = a.dst JOIN sn c ON c.src = a.src AND c.dst = b.dst
  WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst AND a.d + b.d = c.d GROUP BY a.dst),
bw AS (SELECT node_id, coalesce(value, 0) / ((SELECT count(*) FROM nodes) - 1.0::DOUBLE) / ((SELECT count(*) FROM nodes) - 2) AS value FROM nodes LEFT JOIN bt USING (node_id))"""


def oracle_sql() -> dict[str, str]:
    vec_blend = f"bl AS (SELECT node_id, [v[1] * 100 + {BETA} * v[2], v[2] * 100] AS v FROM vec)"
    core_mass = [*CORES]
    fracs = f"SELECT node_id, rank, rank + (count(*) OVER (PARTITION BY rank) - 1) / 2.0::DOUBLE AS fractional_rank FROM ({ranked('deg', kind='rank')})"
    tie = "SELECT 1 AS j UNION ALL SELECT 2 UNION ALL SELECT 3"
    jump = "CASE group_id " + " ".join(f"WHEN {g} THEN {0.5**i}" for i, g in enumerate(RANKING)) + " ELSE 0 END"
    cum = lambda ks, ts, hit: f"SELECT method, k, t, round(100 * avg(share), {DIGITS}) AS score FROM (SELECT method, ranking, k, t, avg(CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0 END) AS share FROM (SELECT *, count(*) OVER (PARTITION BY ranking, method) AS n FROM pairs) CROSS JOIN (SELECT unnest({ks}) AS k) CROSS JOIN (SELECT unnest({ts}) AS t) WHERE m <= k GROUP BY ALL) GROUP BY ALL"
    out = {
        "edges_customer_cosource": q(COSOURCE, "SELECT src, dst FROM edges"),
        "degree_rank": q(COSOURCE, DEGREE, ranked("deg")),
        "degree_vector_rank": q(COSOURCE, vector(), rendered("vec")),
        "beta_degree_rank": q(COSOURCE, vector(), vec_blend, rendered("bl")),
        "coreness_rank": q(COSOURCE, *CORES, ranked("core")),
        "priority_core_rank": q(COSOURCE, *peel(40), rendered("peeled")),
        "priority_core_fixpoint": q(NATIONS, *peel(30), rendered("peeled")),
        "clustering_rank": q(COSOURCE, DEGREE, TRIANGLES, PER_NODE, "cc AS (SELECT node_id, CASE WHEN value > 1 THEN 2.0::DOUBLE * (value + coalesce(t, 0)) / (value * (value - 1)) ELSE 0 END AS value FROM deg LEFT JOIN tn USING (node_id))", scored("cc")),
        "group_metrics": q(COSOURCE, *CORES, GROUPS, "SELECT group_id, size, coreness, degree FROM gm"),
        "target_strategies": q(COSOURCE, *CORES, GROUPS, STRATEGIES),
        "restricted_degree_rank": q(COSOURCE, DEGREE, RESTRICT.format(", ".join(map(str, RANKING)))),
        "restricted_first_degree_rank": q(COSOURCE, DEGREE, RESTRICT.format(RANKING[0])),
        "tiebreak_degree_h1": q(COSOURCE, *h_chain(1), "SELECT a.node_id, a.value, CAST(rank() OVER (ORDER BY a.value DESC, b.value DESC) AS INTEGER) AS rank FROM deg a JOIN h1 b USING (node_id)"),
        "fractional_degree_rank": q(COSOURCE, DEGREE, fracs),
        "epidemic_threshold": q(COSOURCE, DEGREE, THRESHOLD, f"SELECT {R('mean_degree', 'mean_squared_degree', 'threshold')} FROM th2"),
        "probability_grid": q(COSOURCE, DEGREE, THRESHOLD, f"SELECT step, round(threshold * (0.8::DOUBLE + (2.0::DOUBLE - 0.8::DOUBLE) * step / 19), {DIGITS}) AS infection_prob FROM th2 CROSS JOIN (SELECT unnest(range(20))::INTEGER AS step)"),
        "bfs3_counts": q(COSOURCE, NEAR, "SELECT src AS node_id, d, count(*) AS n FROM near GROUP BY src, d"),
        "local_gravity_rank": q(COSOURCE, DEGREE, NEAR, gravity("deg"), scored("grav")),
        "gravity_rank": q(COSOURCE, *core_mass, NEAR, gravity("core"), scored("grav")),
        "extended_gravity_rank": q(COSOURCE, *core_mass, NEAR, gravity("core"), "eg AS (SELECT n.node_id, coalesce(sum(g.value), 0)::DOUBLE / 36 AS value FROM nodes n LEFT JOIN adj ON src = n.node_id LEFT JOIN grav36 g ON g.node_id = dst GROUP BY n.node_id)", scored("eg")),
        "gravity_h_rank": q(
            COSOURCE, *h_chain(1), NEAR,
            "hv AS MATERIALIZED (SELECT n.node_id, count(*) FILTER (d.value >= h.value)::DOUBLE AS value FROM nodes n JOIN h1 h ON h.node_id = n.node_id LEFT JOIN adj ON src = n.node_id LEFT JOIN deg d ON d.node_id = dst GROUP BY n.node_id)",
            "shared AS MATERIALIZED (SELECT a.src, a.dst, sum(1.0::DOUBLE / d.value) AS s FROM adj a JOIN adj b ON b.src = a.src JOIN adj c ON c.src = a.dst AND c.dst = b.dst JOIN deg d ON d.node_id = b.dst GROUP BY a.src, a.dst)",
            "con AS (SELECT a.src AS node_id, sum(pow((1 + coalesce(s, 0)) / d.value, 2)) AS c FROM adj a JOIN deg d ON d.node_id = a.src LEFT JOIN shared x ON x.src = a.src AND x.dst = a.dst GROUP BY a.src)",
            gravity("hv"), "gh AS (SELECT node_id, exp(-coalesce(c, 0)) * value AS value FROM grav LEFT JOIN con USING (node_id))", scored("gh")),
        "closeness_rank": q(NATIONS, FAR, "cl AS (SELECT n.node_id, coalesce(count(d)::DOUBLE / sum(d) * (count(d)::DOUBLE / ((SELECT count(*) FROM nodes) - 1)), 0) AS value FROM nodes n LEFT JOIN far ON src = n.node_id GROUP BY n.node_id)", scored("cl"), recursive=True),
        "local_global_rank": q(NATIONS, DEGREE, FAR, "lg AS (SELECT n.node_id, coalesce(max(n.value)::DOUBLE / (SELECT count(*) FROM nodes) * sum(sqrt(o.value) / d), 0) AS value FROM deg n LEFT JOIN far ON src = n.node_id LEFT JOIN deg o ON o.node_id = dst GROUP BY n.node_id)", scored("lg"), recursive=True),
        "entropy_degree_distance_rank": q(
            NATIONS, DEGREE, FAR, "ts AS (SELECT src, sum(value)::DOUBLE AS t FROM adj JOIN deg ON node_id = dst GROUP BY src)",
            "en AS MATERIALIZED (SELECT n.node_id, coalesce(-sum(value / t * log2(value / t)), 0) AS e FROM nodes n LEFT JOIN adj a ON a.src = n.node_id LEFT JOIN deg d ON d.node_id = a.dst LEFT JOIN ts ON ts.src = a.src GROUP BY n.node_id)",
            "ed AS (SELECT n.node_id, coalesce(max(n.value)::DOUBLE / (SELECT count(*) FROM nodes) * sum(sqrt(greatest(a.e + b.e, 0)) / d), 0) AS value FROM deg n JOIN en a ON a.node_id = n.node_id LEFT JOIN far ON src = n.node_id LEFT JOIN en b ON b.node_id = dst GROUP BY n.node_id)", scored("ed"), recursive=True),
        "betweenness_rank": q(NATIONS, FAR, BETWEEN, scored("bw"), recursive=True),
        "component_ids": q(NATIONS, COMPONENT, "SELECT node_id, component FROM comp", recursive=True),
        "largest_component_edges": q(NATIONS, COMPONENT, "SELECT src, dst FROM edges JOIN comp ON node_id = src WHERE component = (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)", recursive=True),
        "pagerank_20": q(COMOMENT, *pagerank(20, "1"), f"SELECT node_id, {R('value')} FROM pr"),
        "pagerank_jump_20": q(COMOMENT, *pagerank(20, jump), f"SELECT node_id, {R('value')} FROM pr"),
        "pagerank_uniform_jump_20": q(COMOMENT, *pagerank(20, f"CASE WHEN group_id IN ({', '.join(map(str, RANKING))}) THEN 1 ELSE 0 END"), f"SELECT node_id, {R('value')} FROM pr"),
        "target_distribution": q(COMOMENT, shares(), f"SELECT group_id, {R('share')} FROM phi"),
        "global_proportional_fair": q(COMOMENT, *pagerank(20, "1"), shares(), f"SELECT node_id, round(value / sum(value) OVER (PARTITION BY n.group_id) * share, {DIGITS}) AS value FROM pr JOIN nodes n USING (node_id) JOIN phi ON phi.group_id = n.group_id"),
        "lfpr_n_20": q(COMOMENT, *lfpr_n(20), f"SELECT node_id, {R('value')} FROM fair"),
        "lfpr_u_20": q(COMOMENT, *lfpr_u(20), f"SELECT node_id, {R('value')} FROM fair"),
        "sir_reach": q(NATIONS, *spread(), f"SELECT node_id, group_id, {R('mean', 'std')}, {RUNS}::BIGINT AS num_simulations FROM sir"),
        "sir_truth_rank": q(NATIONS, *spread(), truth(RANKING, "tr"), "SELECT node_id, rank FROM tr"),
        "sir_snr_rank": q(
            NATIONS, *spread(), f"eps AS (SELECT group_id, quantile_cont(std / sqrt({RUNS}::DOUBLE), 0.5) FILTER (std > 0) AS eps FROM sir GROUP BY group_id)",
            f"bins AS (SELECT node_id, group_id, floor(mean / coalesce(eps, 1 / sqrt({RUNS}::DOUBLE)))::BIGINT AS bin FROM sir JOIN eps USING (group_id))",
            f"bv AS (SELECT node_id, [{', '.join(f'coalesce(max(bin) FILTER (group_id = {g}), 0)' for g in RANKING)}] AS v FROM bins GROUP BY node_id)",
            "SELECT node_id, CAST(rank() OVER (ORDER BY v DESC) AS INTEGER) AS rank FROM bv"),
        "sir_summary": q(
            NATIONS, *spread(), "tot AS (SELECT node_id, sum(mean) AS t FROM sir GROUP BY node_id)",
            "c AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m)",
            f"SELECT max(n) AS num_nodes, count(*) AS num_nodes_evaluated, round(avg(t), {DIGITS}) AS mean_total, round(median(t), {DIGITS}) AS median_total, round(quantile_cont(t, 0.75), {DIGITS}) AS p75_total, count(*) FILTER (t / n > greatest(0.01::DOUBLE, 2.0::DOUBLE * m / n / n)) AS num_significant, count(*) FILTER (t / n > greatest(0.01::DOUBLE, 2.0::DOUBLE * m / n / n))::DOUBLE / max(n) AS significant_ratio FROM tot CROSS JOIN c"),
        "precision_mrr_arhr": q(*metrics(), f"SELECT ranking, method, num_common_nodes, num_truth_top1, {R('mrr', 'precision_at_1', 'arhr_at_1', 'precision_at_5', 'arhr_at_5', 'precision_pct_10', 'arhr_pct_10')} FROM metrics"),
        "kendall_tau": q(
            *pairs(), "ps AS (SELECT a.ranking, a.method, sum(sign(b.m - a.m) * sign(b.s - a.s))::DOUBLE AS p, count(*)::DOUBLE AS n0, count(*) FILTER (a.m = b.m) AS n1, count(*) FILTER (a.s = b.s) AS n2 FROM pairs a JOIN pairs b ON a.ranking = b.ranking AND a.method = b.method AND a.node_id < b.node_id GROUP BY ALL)",
            f"SELECT ranking, method, round(CASE WHEN (n0 - n1) * (n0 - n2) > 0 THEN p / sqrt((n0 - n1) * (n0 - n2)) ELSE 0 END, {DIGITS}) AS kendall_tau FROM ps"),
        "tie_statistics": q(
            COSOURCE, vector((0, 1, 2)), f"pre AS (SELECT j, v[1:j] AS p, count(*) AS c FROM vec CROSS JOIN ({tie}) GROUP BY ALL)",
            f"SELECT j AS component_index, coalesce(sum(c) FILTER (c > 1), 0)::BIGINT AS num_nodes_tied, count(*) AS num_unique_vectors, sum(c)::BIGINT AS num_nodes, round(coalesce(sum(c) FILTER (c > 1), 0)::DOUBLE / sum(c), {DIGITS}) AS fraction_tied FROM pre GROUP BY j"),
        "tie_profile": q(COSOURCE, DEGREE, "b AS (SELECT value, count(*) AS c FROM deg GROUP BY value)", f"SELECT 'degree' AS method, sum(c)::BIGINT AS n_nodes, count(*) AS n_unique_ranks, max(c) AS max_tie_size, round(avg(c), {DIGITS}) AS mean_tie_size, round(100.0::DOUBLE * sum(c) FILTER (c > 1) / sum(c), {DIGITS}) AS pct_tied FROM b"),
        "aggregate_levels": q(
            *metrics(), "ml AS (SELECT *, len(string_split(ranking, '_'))::INTEGER AS ranking_length FROM metrics)",
            "SELECT CASE grouping(method, ranking, ranking_length) WHEN 3 THEN 'by_method' WHEN 1 THEN 'by_ranking' ELSE 'by_ranking_length' END AS level, method, ranking, ranking_length, round(avg(mrr), 6) AS mrr_mean, round(stddev_samp(mrr), 6) AS mrr_std, round(avg(precision_at_5), 6) AS precision_at_5_mean, round(stddev_samp(precision_at_5), 6) AS precision_at_5_std, count(*) AS count FROM ml GROUP BY GROUPING SETS ((method), (method, ranking), (method, ranking_length))"),
        "node_ranks": q(*pairs(), "SELECT node_id, method, s AS ground_truth_rank, m AS method_rank, ranking, count(*) OVER (PARTITION BY ranking, method) AS n_nodes FROM pairs"),
        "cumulative_score": q(*pairs(), cum("[1, 3]", "[1, 5]", "s <= t")),
        "cumulative_score_percent": q(*pairs(), cum("[1]", "[5, 20]", "s / n::DOUBLE * 100 <= t")),
        "best_spreaders": q(
            NATIONS, DEGREE, *spread(), truth(RANKING, "tr"), f"sdv AS (SELECT node_id, [{', '.join(f'max(std) FILTER (group_id = {g})' for g in RANKING)}] AS sd FROM sir GROUP BY node_id)",
            "f AS (SELECT node_id, v, sd FROM deg JOIN tr USING (node_id) JOIN sdv USING (node_id) WHERE value = (SELECT max(value) FROM deg))", "bs AS (SELECT * FROM f WHERE v = (SELECT max(v) FROM f))",
            "SELECT 'degree' AS method, (SELECT count(*) FROM f) AS num_rank1_nodes, count(*) AS num_best_spreaders, " + ", ".join(f"round(100 * avg(v[{i}]) / 5, {DIGITS}) AS group_{i}_pct_mean, round(100 * sqrt(avg(sd[{i}] * sd[{i}]) + var_pop(v[{i}])) / 5, {DIGITS}) AS group_{i}_pct_std" for i in (1, 2)) + " FROM bs"),
        "pareto_front": "SELECT p_partkey, p_retailprice AS x, p_size::DOUBLE AS y FROM part r WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_retailprice >= r.p_retailprice AND o.p_size >= r.p_size AND (o.p_retailprice > r.p_retailprice OR o.p_size > r.p_size))",
        "metric_pivot": q(*metrics(), "SELECT method, " + ", ".join(f"max(round(mrr, {DIGITS})) FILTER (ranking = '{k}') AS \"mrr_{k}\"" for k in ("_".join(map(str, r)) for r in RANKINGS)) + " FROM metrics GROUP BY method"),
        "best_markers": q(*metrics(), "SELECT method, ranking, value, CASE WHEN r <= 2 THEN r END AS marker FROM (SELECT method, ranking, round(mrr, 3) AS value, CAST(dense_rank() OVER (PARTITION BY ranking ORDER BY round(mrr, 3) DESC) AS INTEGER) AS r FROM metrics)"),
        "worst_gap": q(*metrics(), "g AS (SELECT method, ranking, max(round(precision_at_5, 6)) OVER (PARTITION BY ranking) - round(precision_at_5, 6) AS gap FROM metrics)", "SELECT method, round(max(gap), 6) AS worst_gap FROM g GROUP BY method"),
        "selected_nodes": q(COSOURCE, *h_chain(1), "SELECT node_id FROM (SELECT node_id, min(r) AS r FROM (SELECT node_id, dense_rank() OVER (ORDER BY value DESC) AS r FROM deg UNION ALL SELECT node_id, dense_rank() OVER (ORDER BY value DESC) FROM h1) GROUP BY node_id ORDER BY r, node_id LIMIT 25)"),
        "assortativity": q(
            COSOURCE, DEGREE, "mx AS (SELECT a.group_id AS gs, b.group_id AS gd, count(*)::DOUBLE AS e FROM adj JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst GROUP BY ALL)",
            "t AS (SELECT sum(e) AS t FROM mx)", "s AS (SELECT sum(a * a / t / t) AS s FROM (SELECT gs, sum(e) AS a FROM mx GROUP BY gs) CROSS JOIN t)", "tr AS (SELECT sum(CASE WHEN gs = gd THEN e / t ELSE 0 END) AS tr FROM mx CROSS JOIN t)",
            f"SELECT round((SELECT (tr - s) / (1 - s) FROM tr CROSS JOIN s), {DIGITS}) AS attribute_assortativity, round(corr(a.value::DOUBLE, b.value::DOUBLE), {DIGITS}) AS degree_assortativity FROM adj JOIN deg a ON a.node_id = src JOIN deg b ON b.node_id = dst"),
        "edge_mix": q(COSOURCE, "SELECT count(*) FILTER (a.group_id = b.group_id) AS intra_edges, count(*) FILTER (a.group_id <> b.group_id) AS inter_edges, count(*) FILTER (a.group_id = b.group_id) = 0 AS multipartite FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst"),
        "degree_histogram": q(
            COSOURCE, DEGREE, "f AS (SELECT min(value) AS lo, max(value) AS hi, count(DISTINCT value) AS k FROM deg)", "w AS (SELECT lo, CASE WHEN k > 40 THEN greatest(1, (hi - lo + 1) // 40) ELSE 1 END AS size FROM f)",
            "SELECT lo + (value - lo) // size * size AS bucket, count(*) AS n FROM deg CROSS JOIN w GROUP BY ALL"),
        "graph_report": q(
            NATIONS, DEGREE, TRIANGLES, PER_NODE, COMPONENT, FAR, "big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)",
            "ds AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM deg)",
            "cl AS (SELECT avg(CASE WHEN value > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (value * (value - 1)) ELSE 0 END) AS avg_clustering, 2.0::DOUBLE * sum(coalesce(t, 0)) / sum(value * (value - 1)) AS transitivity FROM deg LEFT JOIN tn USING (node_id))",
            "pd AS (SELECT max(d)::BIGINT AS diameter, avg(d) AS avg_path_length FROM far JOIN comp ON node_id = src WHERE component = (SELECT component FROM big))",
            f"SELECT count(*) AS n, (sum(value) / 2)::BIGINT AS m, min(value) AS min_degree, max(value) AS max_degree, (SELECT value FROM ds WHERE i = n // 2) AS median_degree, (SELECT count(DISTINCT component) FROM comp) AS n_components, (SELECT diameter FROM pd) AS diameter, round(avg(value), {DIGITS}) AS avg_degree, round(sum(value)::DOUBLE / (count(*) * (count(*) - 1)), {DIGITS}) AS density, (SELECT round(avg_clustering, {DIGITS}) FROM cl) AS avg_clustering, (SELECT round(transitivity, {DIGITS}) FROM cl) AS transitivity, (SELECT round(avg_path_length, {DIGITS}) FROM pd) AS avg_path_length FROM deg", recursive=True),
    }
    return out | {f"h{k}_rank": q(COSOURCE, *h_chain(k), ranked(f"h{k}")) for k in (1, 2, 3)}
