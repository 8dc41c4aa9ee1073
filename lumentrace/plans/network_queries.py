"""Service functions, reach, impact, audits and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.operators import networks as N
from lumentrace.operators import topology as T
from lumentrace.sources.storage import materialise

from . import bindings as B
from .bindings import sql

Q: dict = {}
O: dict = {}  # noqa: E741


def add(name: str, oracle: str | None):
    def wrap(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return wrap


B.CTES["npath"] = (
    ("hops",),
    """SELECT path_id, step, node, count(*) OVER (PARTITION BY path_id) AS m, lag(node) OVER w AS prev, lead(node) OVER w AS nxt FROM (
SELECT path_id, (row_number() OVER (PARTITION BY path_id ORDER BY pos))::INT AS step, node FROM (SELECT *, lag(node) OVER (PARTITION BY path_id ORDER BY pos) AS b FROM hops) WHERE b IS NULL OR b <> node) WINDOW w AS (PARTITION BY path_id ORDER BY step)""",
)
_SEG = lambda a, b: f"least({a}, {b}) || '-' || greatest({a}, {b})"
_F = lambda role, ident, regen="false": f"{{'role': '{role}', 'id': {ident}, 'regen': {regen}}}"
_IN, _OUT = _F("RELAY_IN", f"'in:' || node || ':' || {_SEG('prev', 'node')}"), _F("RELAY_OUT", f"'out:' || node || ':' || {_SEG('node', 'nxt')}")
_END = lambda role, kind, regen="false": _F(role, f"'{kind}:' || node || ':' || path_id", regen)
B.CTES["fns"] = (
    ("npath",),
    f"""SELECT path_id, step, node, k, f.role AS role, f.id AS id, f.regen AS regen FROM (SELECT path_id, step, node, unnest(range(len(fs)))::INT AS k, unnest(fs) AS f FROM (SELECT *, CASE WHEN step = 1 THEN [{_END("SRC", "src")}, {_OUT}] WHEN step = m THEN [{_IN}, {_END("SNK", "snk")}]
WHEN (step - 1) % 3 = 0 THEN [{_IN}, {_END("SNK", "rsnk", "true")}, {_END("SRC", "rsrc", "true")}, {_OUT}] ELSE [{_IN}, {_OUT}] END AS fs FROM npath WHERE m > 1))""",
)
B.CTES["exist"] = (("fns",), "SELECT DISTINCT id FROM fns WHERE node % 7 <> 3")


def _functions(s, d):
    return N.service_functions(B.hops(s, d))


def _exist(f):
    return f.filter("node % 7 <> 3").select("id")


@add("service_functions", sql("SELECT path_id, step, k, node, role, id, regen FROM fns", "fns"))
def service_functions(s, d):
    return _functions(s, d)


@add(
    "function_edges",
    sql(
        """WITH e AS (SELECT id AS a, role, regen, lead(id) OVER w AS b, lead(role) OVER w AS b_role, lead(regen) OVER w AS b_regen FROM fns WINDOW w AS (PARTITION BY path_id ORDER BY step, k))
SELECT DISTINCT a, b, CASE WHEN role = 'RELAY_OUT' AND b_role = 'RELAY_IN' THEN 'prop' WHEN regen AND b_regen THEN 'regen_boundary' ELSE 'local' END AS kind FROM e WHERE b IS NOT NULL AND a IN (SELECT id FROM exist) AND b IN (SELECT id FROM exist)""",
        "fns",
        "exist",
    ),
)
def function_edges(s, d):
    f = materialise(_functions(s, d), "functions")
    return N.function_edges(f, _exist(f))


@add("service_candidates", sql("SELECT DISTINCT path_id, node, id FROM fns WHERE id IN (SELECT id FROM exist)", "fns", "exist"))
def service_candidates(s, d):
    f = materialise(_functions(s, d), "functions")
    return N.service_candidates(f, _exist(f))


@add("dedupe_roles", sql("SELECT id, x.role AS role, x.node AS node, x.path_id AS first_service, n_services FROM (SELECT id, arg_min({'role': role, 'node': node, 'path_id': path_id}, (path_id, step, k)) AS x, count(DISTINCT path_id) AS n_services FROM fns GROUP BY id)", "fns"))
def dedupe_roles(s, d):
    return N.first_roles(_functions(s, d), B.path_parts(s, d))


@add("relay_groups", sql("SELECT segment, string_agg(id, ',' ORDER BY id) AS relays FROM (SELECT DISTINCT string_split(id, ':')[3] AS segment, id FROM fns WHERE role LIKE 'RELAY%') GROUP BY segment", "fns"))
def relay_groups(s, d):
    return N.relay_groups(_functions(s, d))


_PLACE = " UNION ALL ".join(f"SELECT node, board, '{r}' AS role, list_position({list(k)}, kind) AS p FROM boards WHERE kind IN {k}" for r, k in N.ROLE_KINDS.items())
B.CTES["chosen"] = (
    ("boards",),
    f"""SELECT coalesce(a.node, o.node) AS node, coalesce(a.role, o.role) AS role, coalesce(o.board, a.board) AS board FROM (SELECT node, role, arg_min(board, (p, board)) AS board FROM ({_PLACE}) GROUP BY 1, 2) a
FULL JOIN (SELECT node, 'RELAY' AS role, min(board) AS board FROM boards WHERE board IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 15) GROUP BY node) o ON a.node = o.node AND a.role = o.role""",
)


def _chosen(s, d):
    b = B.boards(s, d)
    failed = B.events(s, d).filter("alarm = 'error' and value > 15").select("board").distinct()
    return N.board_for_role(b, b.join(failed, "board", "left_semi").select("node", F.lit("RELAY").alias("role"), "board"))


@add("board_for_role", sql("SELECT * FROM chosen", "chosen"))
def board_for_role(s, d):
    return _chosen(s, d)


@add(
    "role_paths",
    sql(
        "WITH f AS (SELECT path_id, step, k, board, lag(board) OVER (PARTITION BY path_id ORDER BY step, k) AS prev FROM fns JOIN chosen c ON c.node = fns.node AND c.role = CASE WHEN fns.role LIKE 'RELAY%' THEN 'RELAY' ELSE fns.role END) SELECT path_id, string_agg(board, ',' ORDER BY step, k) AS boards FROM f WHERE prev IS NULL OR prev <> board GROUP BY path_id",
        "fns",
        "chosen",
    ),
)
def role_paths(s, d):
    return N.role_paths(_functions(s, d), _chosen(s, d))


B.CTES["fnboards"] = (
    ("fns", "hops"),
    """SELECT DISTINCT id, board FROM fns f JOIN (SELECT *, bool_or(kind IN ('OA', 'FIU')) OVER w AS gone, bool_or(kind = 'OD') OVER w AS demuxed FROM hops WINDOW w AS (PARTITION BY path_id, node ORDER BY pos)) h ON h.path_id = f.path_id AND h.node = f.node
WHERE (f.role = 'SRC' AND kind IN ('TRIB', 'XCON', 'LINE', 'OM') AND NOT gone) OR (f.role = 'SNK' AND kind IN ('OD', 'LINE', 'XCON', 'TRIB') AND demuxed) OR (f.role LIKE 'RELAY%' AND kind IN ('OA', 'FIU', 'OD', 'OM'))""",
)


@add("service_board_expansion", sql("SELECT * FROM fnboards", "fnboards"))
def service_board_expansion(s, d):
    return N.function_boards(_functions(s, d), B.hops(s, d))


@add(
    "expand_series_to_boards",
    sql("WITH r AS (SELECT DISTINCT id, node FROM fns WHERE role LIKE 'RELAY%' AND node IN (SELECT board FROM metrics)), f AS MATERIALIZED (SELECT board, min(id) AS id FROM fnboards WHERE id IN (SELECT id FROM r) GROUP BY board) SELECT f.board, t, bbe AS value, r.id FROM f JOIN r ON r.id = f.id JOIN metrics m ON m.board = r.node", "fnboards", "metrics"),
)
def expand_series(s, d):
    f = materialise(_functions(s, d), "functions")
    relays = f.filter(F.col("role").startswith("RELAY")).select("id", "node").distinct()
    series = relays.join(B.metrics(s, d).withColumnRenamed("board", "node"), "node").select("id", "t", F.col("bbe").alias("value"))
    return N.expand_series(series, N.function_boards(f, B.hops(s, d)))


@add(
    "optical_reach",
    sql(
        """WITH o AS (SELECT DISTINCT src AS a, dst AS b FROM pairs WHERE src_kind IN ('OM','OA','OD','FIU','REGENIN','REGENOUT') AND dst_kind IN ('OM','OA','OD','FIU','REGENIN','REGENOUT') AND src <> dst), mux AS (SELECT DISTINCT board, node FROM hops WHERE kind = 'OM'),
r AS (SELECT board AS root, board, 0 AS hop FROM mux UNION SELECT root, b, hop + 1 FROM r JOIN o ON o.a = r.board WHERE hop < 8), g AS (SELECT root, board, min(hop) AS hop FROM r GROUP BY 1, 2)
SELECT root AS board, x[2] AS other, x[1] AS hops FROM (SELECT g.root, min((g.hop, g.board)) AS x FROM g JOIN mux t ON t.board = g.board JOIN mux f ON f.board = g.root AND f.node <> t.node GROUP BY g.root)""",
        "pairs",
        recursive=True,
    ),
)
def optical_reach(s, d):
    return N.optical_reach(materialise(B.hops(s, d), "hops"), materialise)


@add(
    "impact_spread",
    sql(
        """WITH e2 AS (SELECT src AS a, dst AS b, 1 + (src + dst) % 5 AS delay FROM edges UNION SELECT dst, src, 1 + (src + dst) % 5 FROM edges), r AS (SELECT board, 0::BIGINT AS arrival, 0 AS hop FROM boards WHERE board IN (SELECT board FROM ev WHERE alarm = 'error' AND value > 19)
UNION SELECT e2.b, arrival + delay, hop + 1 FROM r JOIN e2 ON r.board = e2.a WHERE hop < 3) SELECT board, x[2] AS hop, x[1] AS arrival, round(power(0.5, x[2]), 6) AS scale FROM (SELECT board, min((arrival, hop)) AS x FROM r GROUP BY board) WHERE power(0.5, x[2]) >= 0.2""",
        "boards",
        "edges",
        "ev",
        recursive=True,
    ),
)
def impact_spread(s, d):
    failed = B.boards(s, d).select("board").join(B.events(s, d).filter("alarm = 'error' and value > 19").select("board"), "board", "left_semi")
    e = T.edges(B.hops(s, d)).select("src", "dst", (1 + (F.col("src") + F.col("dst")) % 5).alias("delay"))
    return N.impact_spread(e, failed, materialise, least=0.2)


@add(
    "endpoint_pairs",
    sql(
        """WITH g AS (SELECT domain AS node, board // 9 AS idx, min(board) FILTER (kind = 'TRIB') AS t, min(board) FILTER (kind = 'XCON') AS x, min(board) FILTER (kind = 'LINE') AS l FROM boards WHERE kind IN ('TRIB', 'XCON', 'LINE') GROUP BY 1, 2),
m AS (SELECT node, idx, concat_ws(',', CASE WHEN t IS NULL THEN 'TRIB' END, CASE WHEN x IS NULL THEN 'XCON' END, CASE WHEN l IS NULL THEN 'LINE' END) AS missing, concat_ws(',', CASE WHEN t IS NOT NULL AND x IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = t AND e.dst = x) THEN 'TRIB-XCON' END,
CASE WHEN x IS NOT NULL AND l IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = x AND e.dst = l) THEN 'XCON-LINE' END) AS missing_edges FROM g) SELECT * FROM m WHERE missing <> '' OR missing_edges <> ''""",
        "boards",
        "edges",
    ),
)
def endpoint_pairs(s, d):
    b = B.boards(s, d).select(F.col("domain").alias("node"), F.floor(F.col("board") / 9).alias("idx"), "kind", "board")
    return N.endpoint_pairs(b, T.edges(B.hops(s, d)))


@add("path_edges_missing", sql("SELECT path_id, pos, src, dst FROM pairs WHERE src_node > dst_node AND (src, dst) NOT IN (SELECT src, dst FROM edges WHERE src_node <= dst_node)", "pairs", "edges"))
def path_edges_missing(s, d):
    h = materialise(B.hops(s, d), "hops")
    return N.missing_path_edges(h, T.edges(h).filter("src_node <= dst_node"))


@add("repeated_endpoints", "SELECT o_custkey AS board, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_endpoints(s, d):
    return N.repeated_endpoints(B.table(s, d, "orders").select(F.col("o_custkey").alias("board")))


_OPT = "IN ('OM','OA','OD','FIU','REGENIN','REGENOUT')"


@add("fibre_sections", sql(f"SELECT src, dst, count(DISTINCT path_id) AS n_paths FROM pairs WHERE src_kind {_OPT} AND dst_kind {_OPT} AND src_node <> dst_node GROUP BY 1, 2", "pairs"))
def fibre_sections(s, d):
    return N.fibre_sections(B.hops(s, d))


@add("node_pair_trails", sql("SELECT a, b, x[1] AS path_id, x[3] AS src, x[4] AS dst FROM (SELECT least(src_node, dst_node) AS a, greatest(src_node, dst_node) AS b, min((path_id, pos, src, dst)) AS x FROM pairs WHERE src_node <> dst_node GROUP BY 1, 2)", "pairs"))
def node_pair_trails(s, d):
    return N.node_pair_trails(B.hops(s, d))


@add("domain_union", sql("SELECT board, kind, node, 'a' AS domain_id FROM boards UNION ALL SELECT c_custkey, NULL, NULL, 'b' FROM customer", "boards"))
def domain_union(s, d):
    return N.stacked(a=B.boards(s, d).select("board", "kind", "node"), b=B.table(s, d, "customer").select(F.col("c_custkey").alias("board")))


@add(
    "domain_report",
    sql(
        """WITH pn AS (SELECT domain, node, count(*) AS c FROM boards GROUP BY 1, 2), a AS (SELECT domain, count(*) AS num_nodes, sum(c)::BIGINT AS num_boards, min(c) AS min_per_node, max(c) AS max_per_node, round(avg(c), 1) AS mean_per_node FROM pn GROUP BY 1),
dd AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), e AS (SELECT domain, round(avg(deg), 2) AS avg_degree FROM (SELECT board, count(*) AS deg FROM (SELECT src AS board FROM dd UNION ALL SELECT dst FROM dd) GROUP BY 1) x JOIN boards b ON b.board = x.board GROUP BY 1),
st AS (SELECT path_id, max(m) - 1 AS nh FROM npath GROUP BY 1), p AS (SELECT domain, count(*) AS num_paths, round(avg(nh) FILTER (nh > 0), 2) AS avg_node_hops, round(avg(bh) FILTER (bh > 0), 2) AS avg_board_hops FROM (SELECT DISTINCT h.path_id, domain, n - 1 AS bh, nh FROM hops h JOIN st ON st.path_id = h.path_id) GROUP BY 1),
c AS (SELECT domain, round(avg((board IN (SELECT board FROM hops))::INT), 4) AS coverage FROM boards GROUP BY 1) SELECT a.*, avg_degree, num_paths, avg_node_hops, avg_board_hops, coverage FROM a LEFT JOIN e ON e.domain = a.domain LEFT JOIN p ON p.domain = a.domain JOIN c ON c.domain = a.domain""",
        "boards",
        "edges",
        "npath",
    ),
)
def domain_report(s, d):
    return N.domain_report(materialise(B.hops(s, d), "hops"), B.boards(s, d))


# Boards with samples, whether the catalogue knows them or not.
@add("untraversed_boards", sql("SELECT DISTINCT m.board, domain FROM metrics m LEFT JOIN boards b ON b.board = m.board WHERE m.board NOT IN (SELECT board FROM hops)", "boards", "hops", "metrics"))
def untraversed(s, d):
    seen = B.metrics(s, d).select("board").distinct().join(B.boards(s, d).select("board", "domain"), "board", "left")
    return N.untraversed(B.hops(s, d), seen)


_DNAMES = ["FIU1", "OA1", "OD1", "OM1", "OA2", "FIU2", "OA3", "OD2", "OM2", "OA4", "Line3", "Line4", "XCON1", "Tributary1"]
_WORD = lambda x: f"{_DNAMES}[({x} % {len(_DNAMES)} + 1)::INT]"
_PAIRSQL = lambda pairs, v: " ".join(f"WHEN contains(a, '{x}') AND contains(b, '{y}') THEN '{v}'" for x, y in pairs)
_ONE = lambda names, v: " ".join(f"WHEN contains(a, '{x}') THEN '{v}'" for x in names)


@add(
    "board_direction",
    sql(
        f"""SELECT path_id, pos, CASE {_PAIRSQL([("FIU2", "FIU1")], "U")} {_PAIRSQL([("FIU1", "FIU2")], "L")} {_PAIRSQL(N.FIBRE_UP, "U")} {_PAIRSQL(N.FIBRE_DOWN, "L")} {_PAIRSQL([("Line", "OM1"), ("OD1", "Line")], "U")} {_PAIRSQL([("Line", "OM2"), ("OD2", "Line")], "L")} {_PAIRSQL([("Tributary", "XCON"), ("XCON", "Line")], "U")} END AS fibre,
CASE {_ONE(N.BOARD_UP, "U")} {_ONE(N.BOARD_DOWN, "L")} WHEN contains(a, 'Line') THEN CASE WHEN regexp_extract(a, '(\\d+)\\$', 1)::INT % 2 = 1 THEN 'U' ELSE 'L' END WHEN contains(a, 'XCON') OR contains(a, 'Tributary') THEN '/' END AS board
FROM (SELECT path_id, pos, 'ROADM' || src_node || '-' || {_WORD("src")} || '$0' AS a, 'ROADM' || dst_node || '-' || {_WORD("dst")} || '$0' AS b FROM pairs)""",
        "pairs",
    ),
)
def board_direction(s, d):
    name = lambda n, x: F.concat(F.lit("ROADM"), F.col(n).cast("string"), F.lit("-"), F.element_at(F.array(*[F.lit(w) for w in _DNAMES]), (F.col(x) % len(_DNAMES) + 1).cast("int")), F.lit("$0"))
    p = T.pairs(B.hops(s, d)).select("path_id", "pos", name("src_node", "src").alias("a"), name("dst_node", "dst").alias("b"))
    return p.select("path_id", "pos", N.fibre_direction(F.col("a"), F.col("b")).alias("fibre"), N.board_direction(F.col("a")).alias("board"))
