"""Three-counter series, windows and overlays over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.operators import measures as V
from lumentrace.operators import series as M

from . import bindings as B
from . import series_queries as SQ
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


B.CTES["smoothed"] = (("metrics",), "SELECT *, sum(bbe) OVER (PARTITION BY board ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS smooth FROM metrics")
B.CTES["m3"] = (("smoothed",), "SELECT board, t, bbe, smooth / 1000 AS bber, least(greatest(smooth / 9, 0.0), 1.0) AS es FROM smoothed")


def m3(s, d):
    return M.derive_bber_es(B.metrics(s, d))


@add("board_measures", sql("WITH p AS (SELECT *, max(bbe) OVER (PARTITION BY board) AS peak FROM m3) SELECT board, max(bbe) AS bbe_max, max(bber) AS bber_max, max(es) AS es_max, count(*) AS samples, count(*) FILTER (bbe > greatest(peak * 0.5, 5.0)) AS elevated FROM p GROUP BY board", "m3"))
def board_measures(s, d):
    return V.board_measures(m3(s, d))


_FEATURES = f"""SELECT g.board, round(bbe, 1) AS bbe_max, burst_regions, round(longest_burst_frac, 3) AS longest_burst_frac, round(es, 4) AS es_frac, CASE WHEN bbe > 0 THEN round(bber / bbe * 1000, 2) END AS bber_bbe_ratio, pattern_kind
FROM (SELECT board, max(bbe) AS bbe, max(bber) AS bber, avg(CASE WHEN es > 0.5 THEN 1.0 ELSE 0.0 END) AS es, count(*) AS n FROM m3 GROUP BY board) g JOIN ({SQ.O["burst_regions"]}) b ON b.board = g.board JOIN ({SQ.O["pattern_kind"]}) k ON k.board = g.board WHERE n >= 20"""


@add("pattern_features", sql(_FEATURES, "m3"))
def pattern_features(s, d):
    return V.pattern_features(m3(s, d), gap=12, width=2, least=20)


@add("peak_features", sql(f"WITH f AS ({_FEATURES}), p AS (SELECT arg_max(board, (m, -board)) AS peak_board FROM (SELECT board, max(bbe) AS m FROM m3 GROUP BY board)) SELECT peak_board, f.* FROM f, p ORDER BY board = peak_board DESC, bbe_max DESC, board LIMIT 1", "m3"))
def peak_features(s, d):
    return V.peak_features(m3(s, d), gap=12, width=2, least=20)


@add("available_boards", sql("WITH k AS (SELECT DISTINCT board FROM metrics), a AS (SELECT string_agg(board, ',' ORDER BY board) AS available FROM (SELECT board FROM k ORDER BY board LIMIT 20)) SELECT s.s_suppkey AS board, available FROM supplier s, a WHERE s.s_suppkey NOT IN (SELECT board FROM k) UNION ALL SELECT 1000000 + c_custkey, available FROM customer, a", "metrics"))
def available_boards(s, d):
    asked = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("board")).unionByName(B.table(s, d, "customer").select((F.col("c_custkey") + 1000000).alias("board")))
    return V.missing_board_help(asked, B.metrics(s, d))


@add("event_amplitude_table", f"SELECT * FROM (VALUES {', '.join(str(r) for r in V.EVENT_SHAPES)}) v(event, shape, mult, bber_mult, es_mult, kind, role, peak) WHERE EXISTS (SELECT 1 FROM events)")
def event_amplitudes(s, d):
    some = B.table(s, d, "events").select(F.lit(1).alias("one")).limit(1)
    return V.event_shapes(s).crossJoin(F.broadcast(some)).drop("one")  # one row on the right


_EVENTS = "[" + ", ".join(f"'{r[0]}'" for r in V.EVENT_SHAPES) + "]"
_SHAPES = ", ".join(f"('{r[0]}', {r[3]}, {r[4]})" for r in V.EVENT_SHAPES)


@add("event_derived", sql(f"SELECT board, t, bbe, smooth / 1000 * b AS bber, least(greatest(smooth / (9 * e), 0.0), 1.0) AS es, (smooth >= 9 * e)::INT AS es_hard FROM smoothed JOIN (VALUES {_SHAPES}) v(event, b, e) ON event = {_EVENTS}[(board % 7 + 1)::INT]", "smoothed"))
def event_derived(s, d):
    names = F.array(*[F.lit(r[0]) for r in V.EVENT_SHAPES])
    return V.event_derived(B.metrics(s, d).withColumn("event", F.element_at(names, (F.col("board") % 7 + 1).cast("int"))), V.event_shapes(s))


def _z(c: str, sd: str) -> str:
    return f"abs({c} - avg({c}) FILTER (t < 20) OVER (PARTITION BY board)) / CASE WHEN {sd}({c}) FILTER (t < 20) OVER (PARTITION BY board) > 0 THEN {sd}({c}) FILTER (t < 20) OVER (PARTITION BY board) ELSE 1.0 END"


@add("zscore_three", sql(f"SELECT board, t, round(greatest({', '.join(_z(c, 'stddev_samp') for c in V.METRICS)}) * 1.5, 6) AS z FROM m3", "m3"))
def zscore_three(s, d):
    return V.zscores(m3(s, d), 20, 1.5).withColumn("z", F.round("z", 6))


_SCORES = "SELECT board, t, round(greatest(" + ", ".join(f"abs({c} - avg({c}) OVER (PARTITION BY board)) / greatest(stddev_pop({c}) OVER (PARTITION BY board), 1e-9)" for c in V.METRICS) + "), 6) AS score FROM m3"
_TOP = "SELECT board, t, score, place::INT AS place, min(t) OVER (PARTITION BY board) AS earliest FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY score DESC, t) AS place FROM ({})) WHERE place <= 5"


@add("anomaly_top_times", sql(_TOP.format(_SCORES), "m3"))
def anomaly_top_times(s, d):
    return V.top_times(V.anomalies(m3(s, d)), 5)


@add("score_topk", sql(_TOP.format("SELECT board, t, bbe AS score FROM metrics"), "metrics"))
def score_topk(s, d):
    return V.top_times(B.metrics(s, d).select("board", "t", F.col("bbe").alias("score")), 5)


_SPANS = "(SELECT m.board, min(t) AS first, max(t) AS last FROM metrics m JOIN events e ON e.user_id = m.board AND e.ts = m.ts WHERE event_type = 'error' AND value > 15 GROUP BY 1)"


def _spans(s, d):
    e = B.events(s, d).filter("alarm = 'error' and value > 15").select("board", F.col("ts").cast("timestamp_ntz").alias("ts"))
    m = B.metrics(s, d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return m.join(e, ["board", "ts"]).groupBy("board").agg(F.min("t").alias("first"), F.max("t").alias("last"))


@add("failure_series", sql(f"SELECT m.board, t, bbe, bber, es, t BETWEEN first AND last AS in_failure FROM m3 m JOIN {_SPANS} s ON s.board = m.board WHERE t BETWEEN first - 3 AND last + 3", "m3", "metrics"))
def failure_series(s, d):
    return V.window_slice(m3(s, d), _spans(s, d), 3)


@add("series_side_by_side", sql("SELECT coalesce(a.board, b.board) AS board, coalesce(a.t, b.t) AS t, a.bbe, a.bber, a.es, b.bbe AS bbe_b, b.bber AS bber_b, b.es AS es_b FROM (SELECT * FROM m3 WHERE bbe > 2) a FULL JOIN (SELECT * FROM m3 WHERE bbe < 12) b ON a.board = b.board AND a.t = b.t", "m3"))
def series_side_by_side(s, d):
    m = m3(s, d)
    return V.side_by_side(m.filter("bbe > 2"), m.filter("bbe < 12"))


_HOUR = 6 * 3600


@add(
    "local_alarm_lines",
    sql(
        f"""WITH k AS (SELECT f.event_id, o.alarm, count(*) AS c FROM ev f JOIN ev o ON o.board = f.board AND o.alarm <> 'error' AND o.ts >= f.ts AND o.ts <= f.ts + INTERVAL {_HOUR} SECOND WHERE f.alarm = 'error' GROUP BY 1, 2),
g AS (SELECT event_id, 'alarms=' || sum(c) || ' top=' || array_to_string(list(alarm || '=' || c ORDER BY c DESC, alarm)[1:5], ',') AS line FROM k GROUP BY 1) SELECT f.event_id, board, coalesce(line, 'no local alarms in the window') AS line FROM ev f LEFT JOIN g ON g.event_id = f.event_id WHERE alarm = 'error'""",
        "ev",
    ),
)
def local_alarm_lines(s, d):
    e = B.events(s, d)
    return V.alarms_after(e.filter("alarm = 'error'"), e.filter("alarm <> 'error'"), _HOUR)


_WIN = "(SELECT board, t AS start, t + 3 + (t % 5)::INT AS stop, bbe * 1.5 AS amplitude, CASE WHEN t % 2 = 0 THEN 'ramp' ELSE 'step' END AS shape FROM metrics WHERE bbe > 15)"
_LEVEL = "CASE WHEN shape = 'ramp' THEN amplitude * (m.t - start + 1) / (stop - start) ELSE amplitude END"


def _windows(s, d):
    return B.metrics(s, d).filter("bbe > 15").select("board", F.col("t").alias("start"), (F.col("t") + 3 + F.col("t") % 5).alias("stop"), (F.col("bbe") * 1.5).alias("amplitude"), F.when(F.col("t") % 2 == 0, "ramp").otherwise("step").alias("shape"))


@add("shaped_overlay", sql(f"SELECT m.board, m.t, greatest(m.bbe, coalesce(max({_LEVEL}), m.bbe)) AS bbe FROM metrics m LEFT JOIN {_WIN} w ON w.board = m.board AND m.t >= start AND m.t < stop GROUP BY m.board, m.t, m.bbe", "metrics"))
def shaped_overlay(s, d):
    return V.shaped_overlay(B.metrics(s, d).select("board", "t", "bbe"), _windows(s, d))


@add("sum_deltas", sql(f"WITH o AS (SELECT shape, m.board, m.t, greatest(m.bbe, max({_LEVEL})) - m.bbe AS delta FROM metrics m JOIN {_WIN} w ON w.board = m.board AND m.t >= start AND m.t < stop GROUP BY 1, 2, 3, m.bbe) SELECT m.board, m.t, round(bbe + coalesce(sum(delta), 0.0), 9) AS bbe FROM metrics m LEFT JOIN o ON o.board = m.board AND o.t = m.t GROUP BY m.board, m.t, bbe", "metrics"))
def sum_deltas(s, d):
    m = B.metrics(s, d).select("board", "t", "bbe")
    each = [V.shaped_overlay(m, _windows(s, d).filter(F.col("shape") == k)).withColumn("failure", F.lit(k)) for k in ("ramp", "step")]
    return V.sum_deltas(m, each[0].unionByName(each[1])).withColumn("bbe", F.round("bbe", 9))


def _rise(c: str) -> str:
    return f"round(avg({c}) FILTER (t >= 30) - avg({c}) FILTER (t < 30), 6)"


@add(
    "most_affected",
    sql(
        f"""WITH g AS (SELECT board, {_rise('bbe')} AS bbe, {_rise('bber')} AS bber, {_rise('es')} AS es FROM m3 GROUP BY board), u AS (SELECT board, 'bbe' AS metric, bbe AS delta FROM g UNION ALL SELECT board, 'bber', bber FROM g UNION ALL SELECT board, 'es', es FROM g),
b AS (SELECT board, arg_max(metric, (delta, metric)) AS metric, max(delta) AS delta FROM u WHERE delta IS NOT NULL GROUP BY board), x AS (SELECT *, board IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 18) AS failed FROM b)
SELECT * FROM (SELECT * FROM x WHERE NOT failed AND delta >= 0.1 ORDER BY delta DESC, board LIMIT 8) UNION ALL SELECT * FROM x WHERE failed""",
        "m3",
    ),
)
def most_affected(s, d):
    return V.most_affected(m3(s, d), 30, 0.1, 8, B.events(s, d).filter("alarm = 'error' and value > 18"))


@add(
    "flow_boards",
    sql(
        "WITH f AS (SELECT board, event_id AS ord, CASE WHEN event_id % 3 > 0 THEN alarm END AS role, event_id // 100 AS start, event_id // 100 + 1 AS stop FROM ev) SELECT board, row_number() OVER (ORDER BY min(ord), board) AS place, arg_min(role, ord) FILTER (role IS NOT NULL) AS role, array_to_string(list_transform(list_sort(list_distinct(list((start, stop)))), lambda x: x[1] || '-' || x[2]), ',') AS windows FROM f GROUP BY board",
        "ev",
    ),
)
def flow_boards(s, d):
    k = F.floor(F.col("event_id") / 100)
    return V.flow_boards(B.events(s, d).select("board", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 > 0, F.col("alarm")).alias("role"), k.alias("start"), (k + 1).alias("stop")))
