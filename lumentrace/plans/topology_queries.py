"""Topology and propagation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.operators import propagation as P
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


@add("path_hops", sql("SELECT path_id, pos, board, node, kind, role FROM hops", "hops"))
def path_hops(s, d):
    return B.hops(s, d).select("path_id", "pos", "board", "node", "kind", "role")


@add("role_map", sql("SELECT board, role FROM role_map", "role_map"))
def role_map(s, d):
    return T.role_map(B.hops(s, d))


@add("typed_boards", sql("SELECT board, node, kind, name, role, ftype FROM typed", "typed"))
def typed_boards(s, d):
    return T.typed_boards(B.boards(s, d), B.hops(s, d)).select("board", "node", "kind", "name", "role", "ftype")


@add("adjacency", sql("SELECT src AS board, dst AS neighbour, 'D' AS direction, edge_type FROM edges UNION ALL SELECT dst, src, 'U', edge_type FROM edges", "edges"))
def adjacency(s, d):
    return T.adjacency(B.hops(s, d))


_FT = "(VALUES ('ODUk-Creation'), ('ODUk-Termination'), ('OTUk-Relay'), ('OTUk-RegenIn'), ('OTUk-RegenOut')) ft(to_type)"
_NEAR = f"""WITH th AS (SELECT h.path_id, h.pos, h.board, h.kind, t.ftype FROM hops h JOIN typed t ON h.board = t.board),
hit AS (SELECT a.path_id, a.pos, a.board, a.ftype, a.kind, dir.direction, to_type,
  CASE WHEN direction = 'D' THEN (SELECT min(b.pos) FROM th b WHERE b.path_id = a.path_id AND b.pos > a.pos AND b.ftype = to_type)
       ELSE (SELECT max(b.pos) FROM th b WHERE b.path_id = a.path_id AND b.pos < a.pos AND b.ftype = to_type) END AS at,
  CASE WHEN direction = 'D' THEN (SELECT min(b.pos) FROM th b WHERE b.path_id = a.path_id AND b.pos > a.pos AND b.kind IN ('REGENIN','REGENOUT'))
       ELSE (SELECT max(b.pos) FROM th b WHERE b.path_id = a.path_id AND b.pos < a.pos AND b.kind IN ('REGENIN','REGENOUT')) END AS wall
  FROM th a, (VALUES ('D'), ('U')) dir(direction), {_FT})"""


@add("nearest_of_type", sql(_NEAR + " SELECT DISTINCT hit.board, direction, to_type, th.board AS target FROM hit JOIN th ON th.path_id = hit.path_id AND th.pos = hit.at", "hops", "typed"))
def nearest_of_type(s, d):
    h = B.hops(s, d)
    return T.nearest_of_type(h, T.typed_boards(B.boards(s, d), h), parts=B.path_parts(s, d))


_SECTION = (
    _NEAR
    + """, tgt AS (SELECT hit.board, direction, to_type, t.board AS target, arg_min(CASE WHEN direction = 'D' THEN CASE WHEN hit.kind = 'REGENIN' AND x.kind = 'REGENOUT' THEN 'regen_boundary' ELSE hit.kind || '_' || x.kind END
 ELSE CASE WHEN x.kind = 'REGENIN' AND hit.kind = 'REGENOUT' THEN 'regen_boundary' ELSE x.kind || '_' || hit.kind END END, (hit.path_id, CASE WHEN direction = 'D' THEN CASE WHEN hit.kind = 'REGENIN' AND x.kind = 'REGENOUT' THEN 'regen_boundary' ELSE hit.kind || '_' || x.kind END
 ELSE CASE WHEN x.kind = 'REGENIN' AND hit.kind = 'REGENOUT' THEN 'regen_boundary' ELSE x.kind || '_' || hit.kind END END)) AS edge_type
FROM hit JOIN th t ON t.path_id = hit.path_id AND t.pos = hit.at JOIN th x ON x.path_id = hit.path_id AND x.pos = hit.pos + CASE WHEN direction = 'D' THEN 1 ELSE -1 END
WHERE hit.ftype <> 'OTUk-Relay' OR wall IS NULL OR (direction = 'D' AND hit.at <= wall) OR (direction = 'U' AND hit.at >= wall) GROUP BY 1, 2, 3, 4)"""
)


@add("nearest_of_type_sectioned", sql(_SECTION + " SELECT board, direction, to_type, target, edge_type FROM tgt", "hops", "typed"))
def nearest_sectioned(s, d):
    h = B.hops(s, d)
    return T.nearest_of_type(h, T.typed_boards(B.boards(s, d), h), sectioned=True, parts=B.path_parts(s, d))


@add("node_path", sql("SELECT path_id, (row_number() OVER (PARTITION BY path_id ORDER BY pos))::INT AS step, node FROM (SELECT path_id, pos, node, lag(node) OVER (PARTITION BY path_id ORDER BY pos) AS p FROM hops) WHERE p IS NULL OR p <> node", "hops"))
def node_path(s, d):
    return T.node_path(B.hops(s, d))


@add("node_graph", sql("SELECT DISTINCT least(src_node, dst_node) AS a, greatest(src_node, dst_node) AS b FROM pairs WHERE src_node <> dst_node", "pairs"))
def node_graph(s, d):
    return T.node_graph(B.hops(s, d))


@add("board_catalog", sql("SELECT node, string_agg(name, ',' ORDER BY name) AS boards, count(*) AS n_boards FROM boards GROUP BY node", "boards"))
def board_catalog(s, d):
    return T.board_catalog(B.boards(s, d))


@add("board_map", sql("SELECT node, kind, string_agg(name, ',' ORDER BY name) AS boards FROM boards GROUP BY node, kind", "boards"))
def board_map(s, d):
    return T.board_map(B.boards(s, d))


_NP = "WITH np AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY pos) AS step, node FROM (SELECT path_id, pos, node, lag(node) OVER (PARTITION BY path_id ORDER BY pos) AS p FROM hops) WHERE p IS NULL OR p <> node)"


@add(
    "services_from_paths",
    sql(
        _NP
        + """, x AS (SELECT *, lead(node) OVER (PARTITION BY path_id ORDER BY step) AS nxt FROM np)
SELECT path_id, arg_min(node, step) AS src, arg_max(node, step) AS dst, string_agg(node::VARCHAR, ',' ORDER BY step) AS node_path,
string_agg(least(node, nxt) || '-' || greatest(node, nxt), ',' ORDER BY step) FILTER (nxt IS NOT NULL) AS segments FROM x GROUP BY path_id HAVING count(*) > 1""",
        "hops",
    ),
)
def services(s, d):
    return T.services(B.hops(s, d))


@add(
    "service_roles",
    sql(
        _NP
        + """, x AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS m FROM np), r AS (SELECT path_id, step, node, CASE WHEN step = 1 THEN ['SRC'] WHEN step = m THEN ['SNK']
WHEN (step - 1) % 3 = 0 THEN ['SNK', 'SRC'] ELSE ['RELAY_IN', 'RELAY_OUT'] END AS roles FROM x WHERE m > 1)
SELECT path_id, step::INT AS step, node, (unnest(range(len(roles))))::INT AS k, unnest(roles) AS role FROM r""",
        "hops",
    ),
)
def service_roles(s, d):
    return T.service_roles(B.hops(s, d))


@add(
    "query_topology",
    sql(
        """WITH w AS (SELECT *, lag(board) OVER p AS up, lead(board) OVER p AS down FROM hops WINDOW p AS (PARTITION BY path_id ORDER BY pos))
SELECT w.board, array_to_string(list_sort(list_distinct(list(up))), ',') AS upstream, array_to_string(list_sort(list_distinct(list(down))), ',') AS downstream,
count(DISTINCT path_id) AS n_paths, count(*) AS n_places FROM w WHERE board IN (SELECT board FROM ev WHERE alarm = 'error') GROUP BY w.board""",
        "hops",
        "ev",
    ),
)
def query_topology(s, d):
    return T.query_topology(B.hops(s, d), B.events(s, d).filter("alarm = 'error'").select("board").distinct())


@add("trace_service_path", sql("SELECT path_id, string_agg(board::VARCHAR, '>' ORDER BY pos) AS trace, count(DISTINCT node) AS n_nodes, count(DISTINCT domain) AS n_domains, count(DISTINCT domain) > 1 AS multi_domain FROM hops GROUP BY path_id", "hops"))
def trace(s, d):
    return T.trace_paths(B.hops(s, d))


@add("downstream_index", sql("SELECT board, max(n - pos) AS max_downstream FROM hops GROUP BY board HAVING max(n - pos) >= 3", "hops"))
def downstream_index(s, d):
    return T.downstream_index(B.hops(s, d), 3)


@add(
    "downstream_region",
    sql(
        """WITH r AS (SELECT path_id, pos, board, list(board) OVER (PARTITION BY path_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS run FROM hops),
b AS (SELECT board, arg_min(run, (-len(run), path_id, pos)) AS run FROM r GROUP BY board) SELECT board, len(run)::INT AS size, array_to_string(run, ',') AS region FROM b""",
        "hops",
    ),
)
def downstream_region(s, d):
    return T.downstream_region(B.hops(s, d), 4)


@add("upstream_downstream_sets", sql("WITH f AS (SELECT DISTINCT board FROM ev WHERE alarm = 'error'), x AS (SELECT DISTINCT a.board AS failed, CASE WHEN b.pos < a.pos THEN 'up' ELSE 'down' END AS side, b.board FROM hops a JOIN f ON a.board = f.board JOIN hops b ON a.path_id = b.path_id AND a.pos <> b.pos) SELECT failed, side, count(*) AS n, min(board) AS first_board FROM x GROUP BY failed, side", "hops", "ev"))
def stream_sets_whole(s, d):
    failed = B.events(s, d).filter("alarm = 'error'").select("board").distinct()
    return T.stream_sides(B.hops(s, d), failed).groupBy("failed", "side").agg(F.count(F.lit(1)).alias("n"), F.min("board").alias("first_board"))


@add("topology_summary", sql("SELECT count(DISTINCT path_id) AS n_paths, count(DISTINCT board) AS n_boards, count(*) FILTER (role = 'SRC') AS n_src, count(*) FILTER (role = 'TERMINATION') AS n_term, max(n) AS max_hops, count(*) AS n_hops FROM hops", "hops"))
def topology_summary(s, d):
    return T.topology_summary(B.hops(s, d))


@add(
    "endpoint_audit",
    sql(
        """WITH g AS (SELECT node, count(*) FILTER (kind = 'TRIB') AS n_trib, count(*) FILTER (kind = 'XCON') AS n_xcon, count(*) FILTER (kind = 'LINE') AS n_line FROM boards GROUP BY node)
SELECT *, concat_ws(',', CASE WHEN n_trib = 0 THEN 'TRIB' END, CASE WHEN n_xcon = 0 THEN 'XCON' END, CASE WHEN n_line = 0 THEN 'LINE' END) AS missing FROM g WHERE n_trib = 0 OR n_xcon = 0 OR n_line = 0""",
        "boards",
    ),
)
def endpoint_audit(s, d):
    return T.endpoint_audit(B.boards(s, d))


@add("path_edge_check", sql("SELECT path_id, count(*) AS n_hops, count(DISTINCT board) AS n_distinct FROM hops GROUP BY path_id HAVING count(*) <> count(DISTINCT board)", "hops"))
def path_edge_check(s, d):
    return T.repeated_boards(B.hops(s, d))


@add("optical_trails", sql("SELECT path_id, arg_min(board, pos) AS first, arg_max(board, pos) AS last, count(*) AS n_optical FROM hops WHERE kind IN ('OM','OA','OD','FIU','REGENIN','REGENOUT') GROUP BY path_id", "hops"))
def optical_trails(s, d):
    return T.optical_trails(B.hops(s, d))


@add("first_board_of_kind", sql("SELECT kind, arg_min(board, (path_id, pos)) AS board FROM hops GROUP BY kind", "hops"))
def first_of_kind(s, d):
    return T.first_of_kind(B.hops(s, d))


@add("positional_roles", sql("SELECT path_id, pos, board, CASE WHEN role <> '' THEN role WHEN kind IN ('OM','OA','OD','FIU','REGENIN','REGENOUT') THEN 'RELAY' WHEN pos <= 3 THEN 'SRC' WHEN pos > n - 3 THEN 'TERMINATION' ELSE 'RELAY' END AS role FROM hops", "hops"))
def positional_roles(s, d):
    return T.positional_roles(B.hops(s, d))


@add("missing_boards", sql("SELECT DISTINCT board FROM ev WHERE board NOT IN (SELECT board FROM boards)", "boards", "ev"))
def missing_boards(s, d):
    return B.events(s, d).select("board").distinct().join(B.boards(s, d).select("board"), "board", "left_anti")


@add("domain_stats", sql("WITH pn AS (SELECT domain, node, count(*) AS n FROM boards GROUP BY 1, 2), a AS (SELECT domain, count(*) AS n_nodes, sum(n)::BIGINT AS n_boards, min(n) AS min_per_node, max(n) AS max_per_node, avg(n) AS avg_per_node FROM pn GROUP BY domain), b AS (SELECT domain, count(DISTINCT path_id) AS n_paths, count(*) AS n_hops FROM hops GROUP BY domain) SELECT a.*, n_paths, n_hops, n_hops / n_paths AS avg_hops FROM a LEFT JOIN b ON a.domain = b.domain", "boards", "hops"))
def domain_stats(s, d):
    return T.domain_stats(B.hops(s, d), B.boards(s, d))


@add("board_type_counts", sql("SELECT kind, count(*) AS n FROM boards GROUP BY kind", "boards"))
def board_type_counts(s, d):
    return B.boards(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@add("avg_degree", sql("WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), g AS (SELECT board, count(*) AS d FROM (SELECT a AS board FROM e UNION ALL SELECT b FROM e) GROUP BY board) SELECT avg(d) AS avg_connected, coalesce(sum(d), 0) / count(*) AS avg_all FROM boards LEFT JOIN g ON boards.board = g.board", "boards", "edges"))
def avg_degree(s, d):
    return T.degree(B.hops(s, d), B.boards(s, d))


@add("path_length_stats", sql("SELECT avg(len) AS avg_len, max(len) AS max_len, min(len) AS min_len, avg(nodes) AS avg_nodes FROM (SELECT path_id, count(*) AS len, count(DISTINCT node) AS nodes FROM hops GROUP BY path_id)", "hops"))
def path_length_stats(s, d):
    return T.path_length_stats(B.hops(s, d))


@add("traverse_coverage", sql("SELECT domain, avg(CASE WHEN board IN (SELECT board FROM hops) THEN 1 ELSE 0 END) AS coverage, count(*) FILTER (board NOT IN (SELECT board FROM hops)) AS untraversed FROM boards GROUP BY domain", "boards", "hops"))
def traverse_coverage(s, d):
    return T.traverse_coverage(B.hops(s, d), B.boards(s, d))


_ALL_UND = "e2 AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"


@add("connected_components", sql("WITH " + _ALL_UND + ", r AS (SELECT board, board AS root FROM boards UNION SELECT e2.b, r.root FROM r JOIN e2 ON r.board = e2.a) SELECT board, min(root) AS component FROM r GROUP BY board", "boards", "edges", recursive=True))
def connected_components_whole(s, d):
    return T.connected_components(materialise(T.edges(B.hops(s, d)), "edges"), B.boards(s, d), materialise)


@add("khop_region", sql("WITH " + _ALL_UND + ", r AS (SELECT board AS root, board, 0 AS hop FROM boards UNION SELECT r.root, e2.b, hop + 1 FROM r JOIN e2 ON r.board = e2.a WHERE hop < 2) SELECT root, board, min(hop) AS hop FROM r GROUP BY root, board", "boards", "edges", recursive=True))
def khop_region_whole(s, d):
    links = materialise(T.pairs(B.hops(s, d)).select("src", "dst").distinct(), "links")
    return P.khop_in_cells(links, B.boards(s, d).select("board"), 2, materialise)


_REACT = (
    _SECTION
    + """, has AS (SELECT board, ftype, r.* FROM typed JOIN rules r ON ftype = from_type), react AS (
SELECT board, from_alarm, board AS to_board, to_alarm, rule_idx, '' AS direction, '' AS edge_type FROM has WHERE action = 'Report Locally'
UNION SELECT h.board, from_alarm, e.dst, to_alarm, rule_idx, 'D', e.edge_type FROM has h JOIN edges e ON e.src = h.board AND e.edge_type = 'regen_boundary' WHERE action LIKE '%RegenOut'
UNION SELECT h.board, from_alarm, t.target, to_alarm, rule_idx, t.direction, t.edge_type FROM has h JOIN tgt t ON t.board = h.board AND t.to_type = h.to_type AND t.direction = CASE WHEN action LIKE '%Upstream' THEN 'U' ELSE 'D' END WHERE action IN ('Transmit Upstream', 'Transmit Downstream')),
seeds AS (SELECT t.board AS root, t.board, CASE WHEN ftype = 'ODUk-Creation' THEN 'Line_Disconnect' WHEN ftype = 'ODUk-Termination' THEN 'ODUk_PM_AIS' ELSE 'Fiber_Cut' END AS alarm FROM typed t WHERE t.board IN (SELECT board FROM ev WHERE alarm = 'error'))"""
)
_FLOW = _REACT + """, flow AS (SELECT root, board, alarm, 0 AS hop FROM seeds UNION SELECT f.root, r.to_board, r.to_alarm, f.hop + 1 FROM flow f JOIN react r ON r.board = f.board AND r.from_alarm = f.alarm WHERE f.hop < 4)"""


def _flow_parts(s, d):
    hops = materialise(T.with_boundary(B.hops(s, d)), "hops")
    typed = materialise(T.typed_boards(B.boards(s, d), hops), "typed")
    rules = B.rules(s)
    react = P.reactions(rules, typed, T.nearest_of_type(hops, typed, sectioned=True, parts=B.path_parts(s, d), wanted=P.asked_for(rules)), T.boundaries(hops))
    failed = B.events(s, d).filter("alarm = 'error'").select("board").distinct()
    seeds = typed.join(failed, "board", "left_semi").select(F.col("board").alias("root"), "board", P.root_event(F.col("ftype")).alias("alarm"))
    return hops, typed, materialise(react, "reactions"), materialise(seeds, "seeds")


@add("match_rules", sql(_REACT + " SELECT board, from_alarm, to_board, to_alarm, rule_idx, direction, edge_type FROM react", "hops", "typed", "edges", "rules", "ev", recursive=True))
def match_rules(s, d):
    return _flow_parts(s, d)[2]


@add("seed_alarms", sql(_REACT + " SELECT root, board, alarm FROM seeds", "hops", "typed", "edges", "rules", "ev", recursive=True))
def seed_alarms(s, d):
    return _flow_parts(s, d)[3]


@add("propagate_untimed", sql(_FLOW + " SELECT root, board, alarm, hop FROM flow", "hops", "typed", "edges", "rules", "ev", recursive=True))
def propagate_untimed(s, d):
    _, _, react, seeds = _flow_parts(s, d)
    return P.propagate_in_cells(seeds, react, 4, materialise)


@add(
    "flow_summary",
    sql(
        _FLOW
        + """ SELECT root, count(*) AS "rows", count(DISTINCT board) AS boards, count(DISTINCT alarm) AS alarms, max(hop) AS max_hop,
count(*) FILTER (regexp_matches(alarm, '(?i)OTUK|R_LOS|LOF|LOM')) AS otuk, count(*) FILTER (regexp_matches(alarm, '(?i)LOS|LOF|AIS')) AS critical,
count(*) FILTER (NOT regexp_matches(alarm, '(?i)LOS|LOF|AIS') AND regexp_matches(alarm, '(?i)BDI')) AS major FROM flow GROUP BY root""",
        "hops",
        "typed",
        "edges",
        "rules",
        "ev",
        recursive=True,
    ),
)
def flow_summary(s, d):
    _, _, react, seeds = _flow_parts(s, d)
    return P.summary_of_walk(*P.walk_in_cells(seeds, react, 4, materialise))


@add(
    "regen_compliance",
    sql(
        _FLOW
        + """, g AS (SELECT root, count(*) FILTER (hop > 0 AND ftype = 'ODUk-Termination' AND regexp_matches(alarm, '(?i)OTUK|R_LOS|LOF|LOM')) AS otuk_on_termination,
count(*) FILTER (ftype = 'OTUk-RegenOut' AND alarm LIKE '%AIS%') AS regen_ais, count(*) FILTER (ftype = 'ODUk-Termination' AND NOT regexp_matches(alarm, '(?i)OTUK|R_LOS|LOF|LOM')) AS termination_oduk
FROM flow JOIN typed ON flow.board = typed.board GROUP BY root) SELECT *, otuk_on_termination = 0 AND (regen_ais = 0 OR termination_oduk > 0) AS compliant FROM g""",
        "hops",
        "typed",
        "edges",
        "rules",
        "ev",
        recursive=True,
    ),
)
def regen_compliance(s, d):
    _, typed, react, seeds = _flow_parts(s, d)
    return P.compliance_of_walk(*P.walk_in_cells(seeds, react, 4, materialise), typed)


def _level(h: int) -> str:
    return f""", l{h} AS (SELECT root, r.to_board AS board, r.to_alarm AS alarm, min((arrival_s + CASE WHEN r.direction = '' THEN 0 WHEN r.edge_type = 'regen_boundary' THEN 1 ELSE 4 END, f.board, r.rule_idx)) AS x
FROM f{h - 1} f JOIN react r ON r.board = f.board AND r.from_alarm = f.alarm GROUP BY 1, 2, 3), f{h} AS (SELECT root, board, alarm, {h} AS hop, x[1] AS arrival_s, x[2] AS prev, x[3] AS rule_idx FROM l{h})"""


@add(
    "propagate_timed",
    sql(
        _REACT + ", f0 AS (SELECT root, board, alarm, 0 AS hop, 0 AS arrival_s, board AS prev, -1 AS rule_idx FROM seeds)" + "".join(_level(h) for h in (1, 2, 3, 4)) + " " + " UNION ALL ".join(f"SELECT * FROM f{h}" for h in range(5)),
        "hops",
        "typed",
        "edges",
        "rules",
        "ev",
        recursive=True,
    ),
)
def propagate_timed(s, d):
    _, _, react, seeds = _flow_parts(s, d)
    return P.timed_in_cells(seeds, react, 4, 4, materialise)


@add("lookup_rule", sql("WITH q AS (SELECT DISTINCT CASE WHEN board % 3 = 0 THEN '' ELSE ftype END AS q_type, CASE board % 4 WHEN 0 THEN 'Fiber_Cut' WHEN 1 THEN 'ais' WHEN 2 THEN 'nothing' ELSE 'Line_Disconnect' END AS q_event FROM typed), ex AS (SELECT q_type, q_event, rule_idx, false AS fuzzy FROM q JOIN rules ON q_event = from_alarm AND (q_type = '' OR q_type = from_type)) SELECT * FROM ex UNION ALL SELECT q.q_type, q.q_event, rule_idx, true FROM q JOIN rules ON contains(lower(from_alarm), lower(q_event)) AND (q.q_type = '' OR q.q_type = from_type) WHERE (q.q_type, q.q_event) NOT IN (SELECT q_type, q_event FROM ex)", "typed", "rules"))
def lookup_rule(s, d):
    t = T.typed_boards(B.boards(s, d), B.hops(s, d))
    k = F.col("board") % 4
    q = t.select(F.when(F.col("board") % 3 == 0, "").otherwise(F.col("ftype")).alias("q_type"), F.when(k == 0, "Fiber_Cut").when(k == 1, "ais").when(k == 2, "nothing").otherwise("Line_Disconnect").alias("q_event")).distinct()
    return P.lookup_rule(B.rules(s), q)


@add("uncovered_events", sql("SELECT DISTINCT alarm FROM ev WHERE alarm NOT IN (SELECT from_alarm FROM rules)", "ev", "rules"))
def uncovered_events(s, d):
    return B.events(s, d).select("alarm").distinct().join(F.broadcast(B.rules(s).select(F.col("from_alarm").alias("alarm"))), "alarm", "left_anti")
