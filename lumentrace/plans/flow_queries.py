"""Cascades, rule files and timed alarm flows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.operators import cascades as C
from lumentrace.operators import flows as W
from lumentrace.operators import propagation as P
from lumentrace.operators import ruletables as R
from lumentrace.operators import topology as T
from lumentrace.sources.storage import materialise

from . import bindings as B
from . import topology_queries as TQ
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


# Cascades: every board with an error has failed, at its first one, in a way that fits its kind.

_FAILED = """SELECT board, CASE WHEN kind IN ('OA','OD','OM','FIU') THEN CASE WHEN board % 2 = 0 THEN 'Fiber_Cut' ELSE 'Fiber_Crack' END WHEN kind = 'XCON' THEN CASE WHEN board % 2 = 0 THEN 'XCON_Fabric_Fault' ELSE 'XCON_Port_Down' END ELSE 'Line_Disconnect' END AS event, time
FROM (SELECT b.board, kind, date_trunc('second', min(ts)) AS time FROM ev JOIN boards b ON ev.board = b.board WHERE alarm = 'error' GROUP BY 1, 2)"""
_KINDS = lambda k: "[" + ", ".join(f"'{x}'" for x in k) + "]"
_CRULES = ", ".join(
    f"({i}, '{p}', {_KINDS(pk)}, '{s}', {_KINDS(sk)}, '{r}', {pr}, {lo}, {hi}, {'NULL' if c is None else chr(39) + c + chr(39)})" for i, (p, pk, s, sk, r, pr, lo, hi, c) in enumerate(C.DEFAULT_RULES)
)
B.CTES["failed"] = (("ev", "boards"), _FAILED)
B.CTES["crules"] = ((), f"SELECT * FROM (VALUES {_CRULES}) v(rule_idx, p_event, p_kind, secondary, s_kind, relationship, probability, lo, hi, condition)")
B.CTES["places"] = (("hops",), "SELECT path_id, board, min(pos) AS pos FROM hops GROUP BY 1, 2")
B.CTES["crossed"] = (("hops",), "SELECT DISTINCT path_id, node FROM hops")


def _candidates(level: str) -> str:
    return f"""SELECT board, event, rule_idx, other FROM (
WITH f AS (SELECT DISTINCT l.board, l.event, b.node, b.kind, r.* FROM {level} l JOIN boards b ON l.board = b.board JOIN crules r ON r.p_event = l.event AND list_contains(r.p_kind, b.kind)),
x AS (SELECT f.*, p.path_id, p.pos FROM f JOIN places p ON p.board = f.board),
y AS (SELECT x.board, x.event, x.rule_idx, x.node, x.condition, x.path_id, min((CASE WHEN relationship = 'downstream' THEN h.pos - x.pos ELSE x.pos - h.pos END, h.board, h.node)) AS m FROM x JOIN hops h ON h.path_id = x.path_id AND list_contains(x.s_kind, h.kind)
  WHERE relationship IN ('downstream', 'upstream') AND CASE WHEN relationship = 'downstream' THEN h.pos - x.pos ELSE x.pos - h.pos END > 0 GROUP BY ALL)
SELECT board, event, rule_idx, board AS other FROM f WHERE relationship = 'same_board' AND list_contains(s_kind, kind)
UNION SELECT f.board, f.event, f.rule_idx, b.board FROM f JOIN boards b ON b.node = f.node AND list_contains(f.s_kind, b.kind) AND b.board <> f.board WHERE relationship = 'same_node'
UNION SELECT f.board, f.event, f.rule_idx, b.board FROM (SELECT DISTINCT x.board, x.event, x.rule_idx, x.s_kind, c.node AS at FROM x JOIN crossed c ON c.path_id = x.path_id AND c.node <> x.node WHERE relationship = 'adjacent_node') f JOIN boards b ON b.node = f.at AND list_contains(f.s_kind, b.kind)
UNION SELECT board, event, rule_idx, m[2] FROM y WHERE condition IS NULL OR condition <> 'same_segment' OR m[3] <> node)"""


def _failed(s, d):
    b = B.boards(s, d).select("board", "kind")
    at = B.events(s, d).filter("alarm = 'error'").groupBy("board").agg(F.date_trunc("second", F.min("ts")).cast("timestamp_ntz").alias("time"))
    even = F.col("board") % 2 == 0
    fibre, cross = F.when(even, "Fiber_Cut").otherwise("Fiber_Crack"), F.when(even, "XCON_Fabric_Fault").otherwise("XCON_Port_Down")
    event = F.when(F.col("kind").isin("OA", "OD", "OM", "FIU"), fibre).when(F.col("kind") == "XCON", cross).otherwise("Line_Disconnect")
    return at.join(b, "board").select("board", event.alias("event"), "time")


@add("cascade_candidates", sql(_candidates("failed"), "failed", "crules", "places", "crossed", "hops", "boards"))
def cascade_candidates(s, d):
    return C.candidates(_failed(s, d), C.load_rules(s), B.boards(s, d), materialise(B.hops(s, d), "hops"), parts=B.path_parts(s, d))


_DRAW = "(({}) * 2654435761 + {}) % 1000003"


def _step(n: int, level: str, known: str) -> str:
    rows = f"""SELECT c.other AS board, r.secondary AS event, min((c.board, c.rule_idx, epoch(l.time)::BIGINT + r.lo + ({_DRAW.format("c.board + c.other * 13 + c.rule_idx", 6)}) % (r.hi - r.lo + 1), 5000 + ({_DRAW.format("c.other * 17 + c.rule_idx", 7)}) % 15001)) AS x
FROM cand{n} c JOIN crules r ON r.rule_idx = c.rule_idx JOIN {level} l ON l.board = c.board AND l.event = c.event WHERE ({_DRAW.format("c.board * 31 + c.other * 7 + c.rule_idx", 5)}) / 1000003.0 <= r.probability AND (c.other, r.secondary) NOT IN (SELECT board, event FROM {known}) GROUP BY 1, 2"""
    return f""", cand{n} AS ({_candidates(level)}), level{n} AS (SELECT z.board, z.event, 'Critical' AS severity, make_timestamp(x[3] * 1000000) AS time, x[4] AS duration_ms,
CASE WHEN kind IN ('TRIB', 'XCON', 'LINE') THEN 'SRC' ELSE 'RELAY' END AS board_role, x[1] AS cascaded_from, {n} AS cascade_depth, x[2] AS cascade_rule_idx FROM ({rows}) z JOIN boards b ON b.board = z.board)"""


_CASCADE = "WITH k0 AS (SELECT board, event FROM failed)" + _step(1, "failed", "k0") + ", k1 AS (SELECT * FROM k0 UNION SELECT board, event FROM level1)" + _step(2, "level1", "k1") + " SELECT * FROM level1 UNION ALL SELECT * FROM level2"


@add("resolve_cascades", sql(_CASCADE, "failed", "crules", "places", "crossed", "hops", "boards"))
def resolve_cascades(s, d):
    return C.resolve(_failed(s, d), C.load_rules(s), B.boards(s, d), materialise(B.hops(s, d), "hops"), materialise)


# Rule files: a rule per part, worded by its columns.

_FN = ["OTUk-Relay", "ODUk-Relay", "ODUk-Creation", "Other"]
_ACT = ["Report Locally", "Transmit Upstream", "Transmit Downstream", "Transmit"]
_TGT = ["OM", "optical", "OD", "", "XCON"]
B.CTES["rulefile"] = (
    (),
    f"""SELECT p_partkey AS rule_idx, {_FN}[(p_partkey % 4 + 1)::INT] AS function_type, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS event, {_ACT}[(p_partkey // 4 % 4 + 1)::INT] AS action, {_TGT}[(p_partkey // 16 % 5 + 1)::INT] AS target,
CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'A' || (p_partkey % 13) END AS output FROM part""",
)


def _rulefile(s, d):
    k = F.col("p_partkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    return B.table(s, d, "part").select(
        k.alias("rule_idx"), pick(_FN, k).alias("function_type"), F.when(k % 9 == 0, "").otherwise(F.col("p_brand")).alias("event"), pick(_ACT, F.floor(k / 4)).alias("action"), pick(_TGT, F.floor(k / 16)).alias("target"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("A"), (k % 13).cast("string"))).alias("output"),
    )


@add(
    "canonicalise_rules",
    sql(
        """WITH a AS (SELECT *, CASE function_type WHEN 'OTUk-Relay' THEN 'Line' WHEN 'ODUk-Relay' THEN 'XCON' ELSE 'Tributary' END AS from_type FROM rulefile), b AS (SELECT *, CASE action WHEN 'Report Locally' THEN from_type
WHEN 'Transmit Upstream' THEN CASE from_type WHEN 'Line' THEN 'XCON' ELSE 'Tributary' END WHEN 'Transmit Downstream' THEN CASE WHEN from_type = 'Tributary' THEN 'XCON' WHEN target IN ('OM', 'optical') THEN 'OM' ELSE 'Line' END
ELSE CASE WHEN target IN ('OM', 'optical') THEN 'OM' WHEN target = 'OD' THEN 'OD' ELSE from_type END END AS to_type FROM a)
SELECT rule_idx, from_type, CASE WHEN event = '' THEN 'ANY' ELSE event END AS from_alarm, to_type, CASE WHEN output <> '' THEN output WHEN event <> '' THEN event ELSE 'ANY' END AS to_alarm,
CASE WHEN from_type || '_' || to_type IN ('Tributary_XCON', 'XCON_Line', 'Line_OM', 'OD_Line') THEN from_type || '_' || to_type WHEN target IN ('OM', 'optical') THEN 'Line_OM' END AS edge_type,
function_type || ' / ' || action || CASE WHEN target = '' THEN '' ELSE ' / ' || target END AS note FROM b""",
        "rulefile",
    ),
)
def canonicalise_rules(s, d):
    return R.canonical(_rulefile(s, d))


_FROM = [" electrical", "otuk-relay", "tributary", "XCON"]
_TO = ["xcon", "om", "tributary ", "line"]


@add(
    "normalise_rules",
    f"""WITH r AS (SELECT p_partkey AS k, {['Electrical', 'OTUk-Relay', 'Tributary', 'Xcon']}[(p_partkey % 4 + 1)::INT] AS a, {['Xcon', 'Om', 'Tributary', 'Line']}[(p_partkey // 4 % 4 + 1)::INT] AS b, p_brand, p_size FROM part)
SELECT k AS rule_idx, a AS from_type, p_brand AS from_alarm, b AS to_type, p_brand AS to_alarm, CASE WHEN k % 5 = 0 THEN 'given' WHEN a = 'Electrical' AND b <> 'Line' THEN CASE b WHEN 'Xcon' THEN 'XCON_Line' WHEN 'Om' THEN 'Line_OM' ELSE 'Tributary_XCON' END ELSE a || '_' || b END AS edge_type,
CASE WHEN k % 3 = 0 THEN p_size ELSE 500 END AS delay_ms, CASE WHEN k % 2 = 0 THEN 'Critical' ELSE 'Major' END AS severity FROM r""",
)
def normalise_rules(s, d):
    k = F.col("p_partkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    r = B.table(s, d, "part").select(
        k.alias("rule_idx"), pick(_FROM, k).alias("from_type"), F.concat(F.lit(" "), "p_brand").alias("from_alarm"), pick(_TO, F.floor(k / 4)).alias("to_type"), F.col("p_brand").alias("to_alarm"),
        F.when(k % 5 == 0, " given ").alias("edge_type"), F.when(k % 3 == 0, F.col("p_size").cast("string")).when(k % 3 == 1, "soon").alias("delay_ms"), F.when(k % 2 == 0, "cRITICAL").when(k % 4 == 1, "").alias("severity"),
    )
    return R.normalised(r)


@add("compact_rules", "SELECT p_partkey, p_name AS line FROM part WHERE p_partkey % 6 > 2")
def compact_rules(s, d):
    k = F.col("p_partkey") % 6
    line = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" # "), "p_name")).when(k == 2, F.concat(F.lit("OTUk-RegenIn,"), "p_name")).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return R.compact(B.table(s, d, "part").select("p_partkey", line.alias("line")))


@add("merge_rule_rows", "SELECT DISTINCT p_name AS board, p_type AS event, p_brand AS output_board, 'transmit downstream' AS output_type, 'A' || (p_size % 3) AS output FROM part WHERE p_size % 4 > 0")
def merge_rule_rows(s, d):
    p = B.table(s, d, "part")
    board = F.when(F.col("p_size") % 4 == 0, "OTUk").otherwise(F.col("p_name"))
    rows = p.select(board.alias("board"), F.col("p_type").alias("event"), F.col("p_brand").alias("output_board"), F.lit("transmit downstream").alias("output_type"), F.concat(F.lit("A"), (F.col("p_size") % 3).cast("string")).alias("output"))
    return R.merged(rows, rows.filter(F.col("output") == "A1"))


@add("rule_outputs", "WITH r AS (SELECT p_partkey AS board, string_split(p_type, ' ') AS w FROM part) SELECT board, 'e' AS event, unnest(range(len(w)))::INT AS n, unnest(w) AS output_board, unnest(w) AS output_type, unnest(w) AS output FROM r")
def rule_outputs(s, d):
    listed = F.replace("p_type", F.lit(" "), F.lit(";"))
    return R.one_output_a_row(B.table(s, d, "part").select(F.col("p_partkey").alias("board"), F.lit("e").alias("event"), *[listed.alias(c) for c in ("output_board", "output_type", "output")]))


@add("rule_description", sql("SELECT rule_idx, function_type || ' ' || event || ' -> ' || output || ' (' || action || CASE WHEN target = '' THEN '' ELSE ' to ' || target END || ')' AS sentence FROM rulefile", "rulefile"))
def rule_description(s, d):
    return _rulefile(s, d).select("rule_idx", R.sentence(*[F.col(c) for c in ("function_type", "event", "action", "target", "output")]).alias("sentence"))


# Timed flows: each failed board's first error is a seed.

B.CTES["first_errors"] = (
    ("ev", "typed"),
    """SELECT id, board, event, epoch(ts)::BIGINT AS start_s, CASE WHEN id % 5 > 0 THEN (id % 30000 + 1000) / 1000.0::DOUBLE ELSE 15.0 END AS duration_s FROM (SELECT min((ts, event_id))[2] AS id, date_trunc('second', min(ts)) AS ts, t.board,
CASE WHEN ftype = 'ODUk-Creation' THEN 'Line_Disconnect' WHEN ftype = 'ODUk-Termination' THEN 'ODUk_PM_AIS' ELSE 'Fiber_Cut' END AS event FROM ev JOIN typed t ON ev.board = t.board WHERE alarm = 'error' GROUP BY t.board, ftype) WHERE id % 17 > 0""",
)
_WAIT = "CASE WHEN r.direction = '' THEN 0 WHEN r.edge_type = 'regen_boundary' THEN 1 ELSE 4 END"
_HOPS = 4


def _flow_sql(name: str, only: str = "true", by: str = "board, alarm, arrival_s") -> str:
    """CTEs of a queue's levels, the order kept as a growing list, over the reactions that ``only`` leaves; ``by`` tells a level's rows apart."""
    q = lambda h: f"{name}_q{h}"
    head = f""", {q(0)} AS (SELECT board, event AS alarm, start_s AS arrival_s, 0 AS hop, board AS root, [id::BIGINT] AS ord, event AS root_event, event, start_s, duration_s, NULL::BIGINT AS prev, -1 AS rule_idx, '' AS edge_type, '' AS direction, 0 AS delay_s FROM first_errors)"""
    levels = "".join(
        f""", {name}_n{h} AS (SELECT r.to_board AS board, r.to_alarm AS alarm, q.arrival_s + {_WAIT} AS arrival_s, {h} AS hop, q.root, q.ord || [r.rule_idx::BIGINT, r.to_board::BIGINT] AS ord, q.root_event, q.alarm AS event,
q.arrival_s AS start_s, q.duration_s, q.board AS prev, r.rule_idx, r.edge_type, r.direction, {_WAIT} AS delay_s FROM {q(h - 1)} q JOIN react r ON r.board = q.board AND r.from_alarm = q.alarm WHERE {only}),
{q(h)} AS MATERIALIZED (SELECT * FROM {name}_n{h} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY ord) = 1)"""
        for h in range(1, _HOPS + 1)
    )
    return head + levels + f", {name} AS (" + " UNION ALL ".join(f"SELECT * FROM {q(h)}" for h in range(_HOPS + 1)) + ")"


_TIMED = TQ._REACT + _flow_sql("aflow")
_NEEDS = ("hops", "typed", "edges", "rules", "ev", "first_errors")


def _failures(s, d, typed):
    e = B.events(s, d).filter("alarm = 'error'").groupBy("board").agg(F.min(F.struct("ts", "event_id")).alias("x"))
    f = e.join(typed.select("board", "ftype"), "board").withColumn("id", F.col("x.event_id"))
    bad = F.col("id") % 17 == 0
    return f.select(
        "id", F.when(~bad, F.col("board")).alias("board"), P.root_event(F.col("ftype")).alias("event"), F.date_trunc("second", "x.ts").alias("time"), F.when(F.col("id") % 5 > 0, F.col("id") % 30000 + 1000).alias("duration_ms"), F.lit("").alias("board_role")
    )


def _timed(s, d, brief: bool = False):
    hops, typed, react, _ = TQ._flow_parts(s, d)
    return hops, typed, _flow_of(s, d, typed, react, brief)


def _flow_of(s, d, typed, react, brief: bool):
    return W.flow_in_cells(W.seeds_of(_failures(s, d, typed), typed.select("board", "role")), react, materialise, max_hops=_HOPS, brief=brief)


def _kept(flow, *columns):
    """What is read more than once of a flow, which is walked once."""
    return materialise(flow.select(*columns), "flow-rows")


@add("alarm_flow", sql(_TIMED + " SELECT board, alarm, arrival_s, hop, root, root_event, event, start_s, duration_s, prev, rule_idx, edge_type, direction, delay_s FROM aflow", *_NEEDS, recursive=True))
def alarm_flow(s, d):
    return _timed(s, d)[2]


_SEV = "CASE WHEN regexp_matches({0}, '(?i)LOS|LOF|AIS') THEN 'Critical' WHEN regexp_matches({0}, '(?i)BDI') THEN 'Major' WHEN regexp_matches({0}, '(?i)DEG') THEN 'Minor' ELSE '' END"
_TABLE = f"""SELECT f.board AS source_board, alarm AS source_alarm, event AS source_event, make_timestamp(start_s * 1000000) AS source_start, duration_s, t.role, f.board AS prop_board, alarm AS prop_alarm, make_timestamp(arrival_s * 1000000) AS arrival,
make_timestamp((arrival_s + floor(duration_s)::BIGINT) * 1000000) AS clear, edge_type AS via_edge_type, CASE WHEN ftype LIKE '%OTUk%' THEN 'optical' ELSE 'electrical' END AS layer, direction, {_SEV.format("alarm")} AS severity, delay_s, coalesce(from_type || ' / ' || action || ' / ' || to_type, 'seed') AS rule_note,
f.rule_idx, hop, prev AS prev_board, root AS root_board, root_event FROM aflow f LEFT JOIN typed t ON t.board = f.board LEFT JOIN rules r ON r.rule_idx = f.rule_idx"""


@add("alarm_flow_table", sql(_TIMED + " " + _TABLE, *_NEEDS, recursive=True))
def alarm_flow_table(s, d):
    _, typed, flow = _timed(s, d)
    return W.flow_table(flow, typed, B.rules(s))


@add("alarm_flat", sql(_TIMED + f" SELECT prop_board AS board, prop_alarm AS alarm, arrival AS start_time, clear AS clear_time, severity, source_board, source_alarm, rule_idx FROM ({_TABLE})", *_NEEDS, recursive=True))
def alarm_flat(s, d):
    return W.alarm_flat(alarm_flow_table(s, d))


def _counted(source: str, by: str, item: str, n: int | None = None) -> str:
    top = f" QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, {item}) <= {n}" if n else ""
    return f"(SELECT {by}, string_agg({item} || '=' || c, ',' ORDER BY c DESC, {item}) AS text FROM (SELECT {by}, {item}, count(*) AS c FROM {source} GROUP BY 1, 2{top}) GROUP BY {by})"


@add(
    "flow_report",
    sql(
        _TIMED
        + f""" SELECT g.*, a.text AS top_alarms, r.text AS rule_counts FROM (SELECT root, count(*) AS "rows", count(DISTINCT board) AS prop_boards, count(DISTINCT prev) AS prev_boards, max(hop) AS max_hop FROM aflow GROUP BY root) g
JOIN {_counted("aflow", "root", "alarm", 5)} a ON a.root = g.root JOIN {_counted("(SELECT root, rule_idx::VARCHAR AS rule FROM aflow)", "root", "rule", 5)} r ON r.root = g.root""",
        *_NEEDS,
        recursive=True,
    ),
)
def flow_report(s, d):
    return W.flow_report(_kept(_timed(s, d, brief=True)[2], "root", "board", "prev", "alarm", "rule_idx", "hop"))


@add(
    "flow_ground_truth",
    sql(
        _TIMED
        + f""" SELECT g.*, a.text AS alarms, v.text AS severities FROM (SELECT root, array_to_string(list_sort(list_distinct(list(board))), ',') AS boards, max(hop) AS max_hop, least(count(*), 20) AS row_count FROM aflow GROUP BY root) g
JOIN {_counted("aflow", "root", "alarm")} a ON a.root = g.root LEFT JOIN {_counted(f"(SELECT root, {_SEV.format('alarm')} AS severity FROM aflow WHERE {_SEV.format('alarm')} <> '')", "root", "severity")} v ON v.root = g.root""",
        *_NEEDS,
        recursive=True,
    ),
)
def flow_truth(s, d):
    return W.flow_truth(_kept(_timed(s, d, brief=True)[2], "root", "board", "alarm", "hop"))


_OT, _OD = "regexp_matches(alarm, '(?i)OTUK|R_LOS|LOF|LOM')", "contains(upper(alarm), 'ODUK')"


def _analysis(flow: str) -> str:
    n = lambda cond, name: f"count(*) FILTER ({cond}) AS {name}"
    term = "ftype = 'ODUk-Termination'"
    parts = [n(_OT, "otuk_count"), n(_OD, "oduk_count"), n("kind LIKE 'REGEN%'", "regen_count"), n(term, "term_count"), n("ftype = 'ODUk-Creation'", "creation_count"), n(f"{term} AND {_OD}", "oduk_at_term"), n(f"{term} AND {_OT}", "otuk_at_term")]
    parts += [n(f"{_SEV.format('alarm')} = '{v}'", v.lower()) for v in ("Critical", "Major", "Minor")]
    return f"SELECT root, count(*) AS total, count(DISTINCT f.board) AS unique_boards, {', '.join(parts)}, max(hop) AS max_hop FROM {flow} f JOIN typed t ON t.board = f.board GROUP BY root"


@add("flow_analysis", sql(_TIMED + " " + _analysis("aflow"), *_NEEDS, recursive=True))
def flow_analysis(s, d):
    _, typed, flow = _timed(s, d, brief=True)
    return W.flow_analysis(flow, typed)


_PLAIN = _flow_sql("bflow", "r.edge_type <> 'regen_boundary'")
_NAMES = ("total", "unique_boards", "otuk_count", "oduk_count", "regen_count", "otuk_at_term", "critical", "max_hop")


@add(
    "flow_compare",
    sql(
        _TIMED + _PLAIN + f", x AS ({_analysis('aflow')}), y AS ({_analysis('bflow')}) SELECT coalesce(x.root, y.root) AS root, " + ", ".join(f"coalesce(x.{n}, 0) AS a_{n}, coalesce(y.{n}, 0) - coalesce(x.{n}, 0) AS d_{n}" for n in _NAMES) + " FROM x FULL JOIN y ON x.root = y.root",
        *_NEEDS,
        recursive=True,
    ),
)
def flow_compare(s, d):
    _, typed, react, _ = TQ._flow_parts(s, d)
    plain = react.filter("edge_type <> 'regen_boundary'")
    return W.flow_compare(*[W.flow_analysis(_flow_of(s, d, typed, r, brief=True), typed) for r in (react, plain)])


@add(
    "propagation_hits",
    sql(
        _TIMED
        + """, s AS (SELECT DISTINCT a.board AS root, b.board, b.pos < a.pos AS up FROM hops a JOIN hops b ON a.path_id = b.path_id AND a.pos <> b.pos WHERE a.board IN (SELECT root FROM aflow)), g AS (SELECT root, board, bool_or(up) AS up, bool_or(NOT up) AS down FROM s GROUP BY 1, 2)
SELECT f.root, count(*) AS prop_boards, count(*) FILTER (up) AS upstream_hits, count(*) FILTER (down) AS downstream_hits, count(*) FILTER (up IS NULL AND f.board <> f.root) AS unknown FROM (SELECT DISTINCT root, board FROM aflow) f LEFT JOIN g ON g.root = f.root AND g.board = f.board GROUP BY f.root""",
        *_NEEDS,
        recursive=True,
    ),
)
def propagation_hits(s, d):
    hops, _, flow = _timed(s, d, brief=True)
    flow = materialise(flow.select("root", "board").distinct(), "flow-reached")
    return W.propagation_hits(flow, T.stream_sides(hops, flow.select(F.col("root").alias("board")).distinct()))


@add("flow_pair_table", sql(_TIMED + " SELECT root, start_s AS s_time, arrival_s AS t_time, prev AS s_board, board AS t_board, alarm AS af, 1 AS label FROM aflow WHERE rule_idx >= 0", *_NEEDS, recursive=True))
def flow_pair_table(s, d):
    return W.pair_table(_timed(s, d, brief=True)[2])


# Regenerators: roles count for electrical boards only, so that optical failures occur, and rules lead to regenerators.

_MORE = (*B.RULES, ("OTUk-Relay", "Fiber_Cut", "Transmit Downstream", "OTUk-RegenIn", "OTUk_LOS"), ("OTUk-RegenIn", "OTUk_LOS", "Transmit Downstream RegenOut", "OTUk-RegenOut", "OTUk_AIS"), ("OTUk-Relay", "Fiber_Cut", "Transmit Upstream", "OTUk-RegenOut", "OTUk_AIS"))


def _regen_sql(body: str) -> str:
    text = sql(TQ._REACT + _flow_sql("rflow", by="board, alarm, arrival_s, root") + body, *_NEEDS, recursive=True)
    more = ", ".join("(" + ", ".join([str(i), *[f"'{v}'" for v in r]]) + ")" for i, r in enumerate(_MORE))
    roles = B.CTES["role_map"][1]
    text = text.replace(roles, roles.replace("WHERE role <> ''", "WHERE role <> '' AND kind IN ('TRIB', 'XCON', 'LINE')"))
    return text.replace(B.CTES["rules"][1], B.CTES["rules"][1].replace(B._rules_sql, more))


_REGEN = f""", f AS (SELECT r.*, ftype, kind FROM rflow r JOIN typed t ON t.board = r.board), g AS (SELECT f.root, t.ftype AS root_type, count(*) AS total, count(*) FILTER ({_OT}) AS otuk, count(*) FILTER ({_OD}) AS oduk, count(*) FILTER (f.kind LIKE 'REGEN%') AS at_regen,
count(*) FILTER (f.ftype = 'OTUk-RegenIn') AS n_in, count(*) FILTER (f.ftype = 'OTUk-RegenOut') AS n_out, count(*) FILTER (f.ftype = 'OTUk-RegenIn' AND regexp_matches(upper(alarm), 'OTUK|R_LOS|LOF')) AS in_otuk,
count(*) FILTER (f.ftype = 'OTUk-RegenOut' AND contains(upper(alarm), 'AIS')) AS out_ais, count(*) FILTER (f.ftype = 'ODUk-Termination' AND {_OD}) AS term_oduk FROM f JOIN typed t ON t.board = f.root GROUP BY ALL),
i AS (SELECT root, 1 AS "check", board, alarm, 'OTUk alarm over the regenerator at electrical board: ' || board || '/' || alarm AS issue FROM f WHERE board <> root AND edge_type = 'regen_boundary' AND ftype IN ('ODUk-Termination', 'ODUk-Creation') AND {_OT}
UNION ALL SELECT root, 4, board, alarm, 'OTUk alarm over the regenerator at relay: ' || board || '/' || alarm FROM f WHERE board <> root AND edge_type = 'regen_boundary' AND ftype = 'OTUk-Relay' AND regexp_matches(upper(alarm), 'OTUK_LOS|OTUK_LOF')
UNION ALL SELECT root, 2, NULL, NULL, 'optical failure without an OTUk alarm at the ingress' FROM g WHERE root_type = 'OTUk-Relay' AND n_in + n_out > 0 AND in_otuk = 0
UNION ALL SELECT root, 3, NULL, NULL, 'AIS at the egress without an ODUk alarm at a termination' FROM g WHERE root_type = 'OTUk-Relay' AND n_out > 0 AND out_ais > 0 AND term_oduk = 0)"""


def _regen_flow(s, d):
    hops = materialise(T.with_boundary(B.hops(s, d)), "hops")
    electrical = hops.withColumn("role", F.when(F.col("kind").isin("TRIB", "XCON", "LINE"), F.col("role")).otherwise(""))
    typed = materialise(T.typed_boards(B.boards(s, d), electrical), "typed")
    rules = B.rules(s, _MORE)
    react = materialise(P.reactions(rules, typed, T.nearest_of_type(hops, typed, sectioned=True, parts=B.path_parts(s, d), wanted=P.asked_for(rules)), T.boundaries(hops)), "reactions")
    return materialise(W.flow_in_cells(W.seeds_of(_failures(s, d, typed), typed.select("board", "role")), react, materialise, max_hops=_HOPS, per_root=True), "regen-flow"), typed


@add("regen_issues", _regen_sql(_REGEN + ' SELECT root, "check", board, alarm, issue FROM i'))
def regen_issues(s, d):
    return P.regen_issues(*_regen_flow(s, d))


@add("regen_status", _regen_sql(_REGEN + ", n AS (SELECT root, count(*) AS n FROM i GROUP BY root) SELECT g.root, root_type, total, otuk, oduk, at_regen, term_oduk, coalesce(n, 0) AS issues, CASE WHEN n IS NULL THEN 'PASS' ELSE 'FAIL' END AS status FROM g LEFT JOIN n ON n.root = g.root"))
def regen_status(s, d):
    return P.regen_status(*_regen_flow(s, d))


@add(
    "distinct_failures",
    sql(
        """WITH x AS (SELECT CASE WHEN event_id % 19 > 0 THEN e.board END AS board, kind, CASE WHEN alarm = 'error' THEN 'Fiber_Cut' WHEN alarm = 'click' THEN 'XCON_Port_Down' WHEN event_id % 2 = 0 THEN '' END AS event, date_trunc('day', ts) AS time,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 * 1000 END AS duration_ms, CASE WHEN event_id % 4 = 0 THEN 'TERMINATION' WHEN event_id % 4 = 1 THEN 'RELAY' WHEN event_id % 4 = 2 THEN '' END AS role FROM ev e JOIN boards b ON b.board = e.board)
SELECT DISTINCT board, coalesce(event, '') AS event, time, coalesce(duration_ms, 15000)::BIGINT AS duration_ms, CASE WHEN event = 'XCON_Port_Down' THEN 'SRC' WHEN role = 'TERMINATION' THEN 'SNK' WHEN role <> '' THEN role WHEN kind IN ('TRIB', 'XCON', 'LINE') THEN 'SRC' ELSE 'RELAY' END AS role FROM x WHERE board IS NOT NULL""",
        "ev",
        "boards",
    ),
)
def distinct_failures(s, d):
    k = F.col("event_id")
    e = B.events(s, d).join(B.boards(s, d).select("board", "kind"), "board")
    event = F.when(F.col("alarm") == "error", "Fiber_Cut").when(F.col("alarm") == "click", "XCON_Port_Down").when(k % 2 == 0, "")
    role = F.when(k % 4 == 0, "TERMINATION").when(k % 4 == 1, "RELAY").when(k % 4 == 2, "")
    rows = e.select(F.when(k % 19 > 0, F.col("board")).alias("board"), "kind", event.alias("event"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"), F.when(k % 3 > 0, k % 3 * 1000).alias("duration_ms"), role.alias("role"))
    return P.distinct_failures(rows)


@add("distinct_events", sql("SELECT alarm, (row_number() OVER (ORDER BY min((ts, event_id))))::INT AS place FROM ev GROUP BY alarm", "ev"))
def distinct_events(s, d):
    return W.distinct_events(B.events(s, d), "alarm", F.col("ts"), F.col("event_id"))


@add("infer_board_role", sql("SELECT board, CASE WHEN x[2] = 1 THEN 'SRC' WHEN x[2] = x[3] THEN 'SNK' ELSE 'RELAY' END AS role FROM (SELECT board, min((path_id, pos, n)) AS x FROM hops GROUP BY board)", "hops"))
def infer_board_role(s, d):
    return W.infer_roles(B.hops(s, d))
