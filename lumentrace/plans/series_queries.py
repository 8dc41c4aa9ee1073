"""Metric series, root causes and retrieval over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S
from lumentrace.operators import preparation as D
from lumentrace.operators import rootcause as R
from lumentrace.operators import series as M
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


@add("board_max", sql("SELECT board, max(bbe) AS bbe_max FROM metrics GROUP BY board", "metrics"))
def board_max(s, d):
    return M.board_max(B.metrics(s, d))


@add("board_rank", sql("WITH g AS (SELECT board, max(bbe) AS bbe_max FROM metrics GROUP BY board) SELECT board, bbe_max, (row_number() OVER (ORDER BY bbe_max DESC, board))::INT AS rank, count(*) OVER () AS n_boards FROM g", "metrics"))
def board_rank(s, d):
    return M.board_rank(B.metrics(s, d))


@add("top_boards", sql("SELECT board, max(bbe) AS bbe_max FROM metrics GROUP BY board ORDER BY bbe_max DESC, board LIMIT 10", "metrics"))
def top_boards(s, d):
    return M.top_boards(B.metrics(s, d), 10)


_PEAK = "WITH p AS (SELECT *, max(bbe) OVER (PARTITION BY board) AS peak, count(*) OVER (PARTITION BY board) AS samples FROM metrics)"


@add("board_metrics", sql(_PEAK + " SELECT board, max(bbe) AS bbe_max, count(*) AS samples, count(*) FILTER (bbe > greatest(peak * 0.5, 5.0)) AS elevated, avg(CASE WHEN bbe > greatest(peak * 0.5, 5.0) THEN 1.0 ELSE 0.0 END) AS elevated_frac FROM p GROUP BY board", "metrics"))
def board_metrics(s, d):
    return M.board_metrics(B.metrics(s, d))


def _islands(cond: str) -> str:
    return f""", f AS (SELECT *, ({cond})::INT AS h FROM p), g AS (SELECT *, CASE WHEN h = 1 AND coalesce(lag(h) OVER (PARTITION BY board ORDER BY t), 0) = 0 THEN 1 ELSE 0 END AS nw FROM f),
r AS (SELECT *, sum(nw) OVER (PARTITION BY board ORDER BY t) AS run FROM g), runs AS (SELECT board, run, min(t) AS start, max(t) + 1 AS stop, count(*) AS length FROM r WHERE h = 1 GROUP BY board, run)"""


@add("burst_regions", sql(_PEAK + _islands("bbe > greatest(peak * 0.5, 5.0)") + ", x AS (SELECT board, count(*) AS burst_regions, max(length) / sum(length) AS longest_burst_frac FROM runs GROUP BY board) SELECT b.board, coalesce(burst_regions, 0) AS burst_regions, coalesce(longest_burst_frac, 0.0) AS longest_burst_frac FROM (SELECT DISTINCT board FROM metrics) b LEFT JOIN x ON b.board = x.board", "metrics"))
def burst_regions(s, d):
    return M.burst_regions(B.metrics(s, d))


_KIND = (
    _PEAK.replace("FROM metrics)", "FROM metrics QUALIFY samples >= 20)")
    + _islands("bbe > peak * 0.9")
    + """, c1 AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY board ORDER BY start) > 12 THEN 1 ELSE 0 END AS apart FROM runs),
c2 AS (SELECT *, sum(apart) OVER (PARTITION BY board ORDER BY start) AS cluster FROM c1), c3 AS (SELECT board, cluster, count(*) AS n_runs, sum(length) AS total, min(start) AS first, max(stop) AS last FROM c2 GROUP BY board, cluster),
best AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY total DESC, cluster) AS k FROM c3), bt AS (SELECT p.board, avg(bbe) AS inter_mean FROM p JOIN best b ON p.board = b.board AND k = 1 AND t >= first AND t < last AND bbe <= peak * 0.9 GROUP BY p.board),
pk AS (SELECT board, max(peak) AS bbe_max FROM p GROUP BY board), kinds AS (SELECT pk.board, bbe_max, coalesce(n_runs, 0) AS n_runs, round(inter_mean, 6) AS inter_mean,
CASE WHEN n_runs = 1 AND total > 2 THEN 'step' WHEN coalesce(n_runs, 0) <= 1 THEN 'ramp' WHEN inter_mean > bbe_max * 0.7 THEN 'step_recovery' ELSE 'burst' END AS pattern_kind
FROM pk LEFT JOIN best ON pk.board = best.board AND k = 1 LEFT JOIN bt ON pk.board = bt.board)"""
)


@add("pattern_kind", sql(_KIND + " SELECT * FROM kinds", "metrics"))
def pattern_kind(s, d):
    return M.pattern_kind(B.metrics(s, d), gap=12, width=2, least=20).withColumn("inter_mean", F.round("inter_mean", 6))


@add("local_alarms", sql("WITH x AS (SELECT *, coalesce(bbe - lag(bbe) OVER (PARTITION BY board ORDER BY t), 0) AS dl FROM metrics) SELECT board, t, bbe, CASE WHEN bbe >= 4 AND dl >= 2 THEN 'SPIKE' ELSE 'SHIFT' END AS alarm, CASE WHEN bbe >= 4 AND dl >= 2 THEN 'Major' ELSE 'Minor' END AS severity FROM x WHERE (bbe >= 4 AND dl >= 2) OR (bbe >= 2 AND dl >= 1)", "metrics"))
def local_alarms(s, d):
    return M.local_alarms(B.metrics(s, d))


_SMOOTH = "WITH m AS (SELECT board, t, bbe, round(sum(bbe::DECIMAL(18,6)) OVER (PARTITION BY board ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)::DOUBLE / 10, 6) AS smooth FROM metrics)"


@add("smooth", sql(_SMOOTH + " SELECT board, t, smooth FROM m", "metrics"))
def smooth(s, d):
    m = B.metrics(s, d).withColumn("bbe", F.col("bbe").cast("decimal(18,6)"))
    return M.smooth(m).select("board", "t", F.round(F.col("smooth").cast("double"), 6).alias("smooth"))


@add("derive_bber_es", sql(_SMOOTH + " SELECT board, t, round(smooth / 1000, 6) AS bber, round(least(greatest(smooth / 9, 0.0), 1.0), 4) AS es FROM m", "metrics"))
def derive(s, d):
    x = M.derive_bber_es(B.metrics(s, d))
    return x.select("board", "t", F.round("bber", 6).alias("bber"), F.round("es", 4).alias("es"))


@add("zscore_baseline", sql("WITH x AS (SELECT board, t, bbe, avg(bbe) FILTER (t < 20) OVER (PARTITION BY board) AS mu, stddev_samp(bbe) FILTER (t < 20) OVER (PARTITION BY board) AS sd FROM metrics) SELECT board, t, round(abs(bbe - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 5) AS z FROM x", "metrics"))
def zscore(s, d):
    return M.zscore_baseline(B.metrics(s, d), 20).withColumn("z", F.round("z", 5))


@add("pseudo_anomaly", sql("WITH x AS (SELECT board, t, round(abs(bbe - avg(bbe) OVER w) / greatest(stddev_pop(bbe) OVER w, 1e-9), 6) AS z FROM metrics WINDOW w AS (PARTITION BY board)), y AS (SELECT *, (row_number() OVER (PARTITION BY board ORDER BY z DESC, t))::INT AS place FROM x) SELECT board, t, round(z, 4) AS z, place FROM y WHERE place <= 3", "metrics"))
def pseudo(s, d):
    return M.pseudo_anomaly(B.metrics(s, d), 3).withColumn("z", F.round("z", 4))


@add("series_stats", sql("SELECT board, round(avg(bbe), 6) AS mean, round(stddev_pop(bbe), 6) AS sd, round(quantile_cont(bbe, 0.95), 6) AS p95, max(bbe) AS max FROM metrics GROUP BY board", "metrics"))
def stats(s, d):
    x = M.series_stats(B.metrics(s, d))
    return x.select("board", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("p95", 6).alias("p95"), "max")


@add("threshold_spans", sql("WITH p AS (SELECT *, avg(bbe) OVER (PARTITION BY board) AS mu, stddev_pop(bbe) OVER (PARTITION BY board) AS sd FROM metrics)" + _islands("bbe >= round(mu + sd, 9)") + " SELECT board, start, stop, length FROM runs WHERE length >= 2", "metrics"))
def spans(s, d):
    return M.threshold_spans(B.metrics(s, d), 1.0, 2)


@add("worst_case_series", sql("SELECT node AS grp, t, max(bbe) AS worst, round(avg(bbe), 6) AS mean FROM metrics m JOIN boards b ON m.board = b.board GROUP BY node, t", "metrics", "boards"))
def worst(s, d):
    groups = B.boards(s, d).select("board", F.col("node").alias("grp"))
    return M.worst_case(B.metrics(s, d), groups).withColumn("mean", F.round("mean", 6))


@add("alarms_after_failure", sql("WITH f AS (SELECT * FROM ev WHERE alarm = 'error'), g AS (SELECT f.event_id, count(*) AS n_after, count(DISTINCT o.alarm) AS kinds FROM f JOIN ev o ON o.board = f.board AND o.alarm <> 'error' AND o.ts >= f.ts AND o.ts <= f.ts + INTERVAL 6 HOUR GROUP BY f.event_id) SELECT f.event_id, board, coalesce(n_after, 0) AS n_after, coalesce(kinds, 0) AS kinds FROM f LEFT JOIN g ON f.event_id = g.event_id", "ev"))
def after(s, d):
    return M.alarms_after_failure(B.events(s, d), 6 * 3600)


@add("failure_window_slice", sql("WITH sp AS (SELECT board, min(ts) AS a, max(ts) AS b FROM ev WHERE alarm = 'error' GROUP BY board) SELECT ev.board, count(*) AS samples, max(value) AS peak FROM ev JOIN sp ON ev.board = sp.board AND ts >= a - INTERVAL 1 HOUR AND ts <= b + INTERVAL 1 HOUR GROUP BY ev.board", "ev"))
def window_slice(s, d):
    return M.failure_windows(B.events(s, d), 3600)


@add("stagger", sql("WITH i AS (SELECT board % 25 AS node, event_id AS id, floor(epoch(ts))::BIGINT AS t0, (event_id % 5 + 1) * 600 AS dur FROM ev WHERE alarm = 'error'), c AS (SELECT *, coalesce(sum(dur + 60) OVER (PARTITION BY node ORDER BY t0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM i) SELECT node, id, t0, dur, (c + max(t0 - c) OVER (PARTITION BY node ORDER BY t0, id))::BIGINT AS start FROM c", "ev"))
def stagger(s, d):
    e = B.events(s, d).filter("alarm = 'error'")
    i = e.select((F.col("board") % 25).alias("node"), F.col("event_id").alias("id"), F.unix_seconds("ts").alias("t0"), ((F.col("event_id") % 5 + 1) * 600).alias("dur"))
    return M.stagger(i, 60)


@add("affected_boards", sql("WITH g AS (SELECT board, round(avg(bbe) FILTER (t >= 30) - avg(bbe) FILTER (t < 30), 6) AS delta FROM metrics GROUP BY board) SELECT * FROM g WHERE delta >= 1", "metrics"))
def affected(s, d):
    return M.affected_boards(B.metrics(s, d), 30, 1.0)


@add("overlay_alarm_windows", sql("WITH w AS (SELECT board, t AS start, t + 90 AS stop, 40.0 + t % 7 AS amp FROM metrics WHERE t % 29 = 3) SELECT m.board, m.t, greatest(m.bbe, coalesce(max(amp), m.bbe)) AS bbe FROM metrics m LEFT JOIN w ON m.board = w.board AND m.t >= w.start AND m.t < w.stop GROUP BY m.board, m.t, m.bbe", "metrics"))
def overlay(s, d):
    m = B.metrics(s, d).select("board", "t", "bbe")
    w = m.filter("t % 29 = 3").select("board", F.col("t").alias("start"), (F.col("t") + 90).alias("stop"), (F.lit(40.0) + F.col("t") % 7).alias("amplitude"))
    return M.overlay(m, w)


@add("session_bursts", sql("WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY board ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM ev), y AS (SELECT *, sum(nw) OVER (PARTITION BY board ORDER BY ts) AS sid FROM x) SELECT board, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n, max(value) AS peak FROM y GROUP BY board, sid", "ev"))
def sessions(s, d):
    x = M.stream_alarms_sessions(B.events(s, d), "2 hours")
    return x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


_NEAREST = "(SELECT e FROM (VALUES (28.0, 0, 'Fiber_Aging', 'Fiber'), (32.0, 1, 'XCON_Port_Down', 'XCON'), (36.0, 2, 'Line_Disconnect', 'Line'), (42.0, 3, 'Fiber_Crack', 'Fiber'), (46.0, 4, 'XCON_Buffer_Overflow', 'XCON'), (50.4, 5, 'XCON_Fabric_Fault', 'XCON'), (55.0, 6, 'Fiber_Cut', 'Fiber')) v(p, i, e, c) {} ORDER BY abs(x.bbe_max - p::DOUBLE), i LIMIT 1)"
_CAT = "CASE WHEN kind IN ('OA','OD','OM','FIU','REGENIN','REGENOUT') THEN 'Fiber' WHEN kind = 'XCON' THEN 'XCON' ELSE 'Line' END"


@add("nearest_reference_event", sql("WITH x AS (SELECT board, max(bbe) / 2 AS bbe_max FROM metrics GROUP BY board) SELECT board, CASE WHEN bbe_max > 0 THEN " + _NEAREST.format("") + " END AS event FROM x", "metrics"))
def nearest(s, d):
    return M.board_max(B.metrics(s, d)).select("board", R.nearest_event(F.col("bbe_max") / 2).alias("event"))


@add(
    "predict_root_cause",
    sql(
        _KIND
        + f""", x AS (SELECT k.board, {_CAT} AS category, CASE WHEN k.board % 3 = 0 THEN pattern_kind ELSE 'unknown' END AS pattern, bbe_max / 2 AS bbe_max FROM kinds k JOIN boards b ON k.board = b.board)
SELECT board, category, pattern, coalesce(CASE WHEN category = 'Line' AND pattern <> 'unknown' THEN 'Line_Disconnect' WHEN category = 'Fiber' THEN CASE pattern WHEN 'ramp' THEN 'Fiber_Aging' WHEN 'step' THEN 'Fiber_Cut' WHEN 'step_recovery' THEN 'Fiber_Crack' WHEN 'burst' THEN 'Fiber_Aging' END
WHEN category = 'XCON' THEN CASE pattern WHEN 'ramp' THEN 'XCON_Port_Down' WHEN 'step' THEN 'XCON_Port_Down' WHEN 'step_recovery' THEN 'XCON_Fabric_Fault' WHEN 'burst' THEN 'XCON_Buffer_Overflow' END END,
CASE WHEN bbe_max > 0 THEN {_NEAREST.format("WHERE c = x.category")} END, CASE category WHEN 'Fiber' THEN 'Fiber_Cut' WHEN 'XCON' THEN 'XCON_Port_Down' ELSE 'Line_Disconnect' END) AS event FROM x""",
        "metrics",
        "boards",
    ),
)
def predict(s, d):
    k = M.pattern_kind(B.metrics(s, d), gap=12, width=2, least=20)
    x = k.join(B.boards(s, d).select("board", "kind"), "board")
    x = x.select("board", S.board_category(F.col("kind")).alias("category"), F.when(F.col("board") % 3 == 0, F.col("pattern_kind")).otherwise("unknown").alias("pattern"), (F.col("bbe_max") / 2).alias("peak"))
    return x.select("board", "category", "pattern", R.root_cause(F.col("category"), F.col("pattern"), F.col("peak")).alias("event"))


@add(
    "search_similar",
    sql(
        _KIND
        + """, c AS (SELECT k.board AS id, kind, pattern_kind AS pattern, bbe_max AS peak FROM kinds k JOIN boards b ON k.board = b.board),
y AS (SELECT q.id AS q_id, c.id AS case_id, round(CASE WHEN q.pattern = c.pattern THEN 0.4 ELSE 0 END + CASE WHEN q.kind = c.kind THEN 0.3 ELSE 0 END + 0.3 * greatest(0.0, 1 - abs(q.peak - c.peak) / 8.0), 9) AS score
FROM c q JOIN c ON abs(q.peak - c.peak) <= 8.0 AND q.id <> c.id), z AS (SELECT *, (row_number() OVER (PARTITION BY q_id ORDER BY score DESC, case_id))::INT AS rank FROM y) SELECT q_id, rank, case_id, score FROM z WHERE rank <= 3""",
        "metrics",
        "boards",
    ),
)
def similar(s, d):
    k = M.pattern_kind(B.metrics(s, d), gap=12, width=2, least=20)
    c = k.join(B.boards(s, d).select("board", "kind"), "board").select("board", "kind", F.col("pattern_kind").alias("pattern"), F.col("bbe_max").alias("peak"))
    c = materialise(c, "cases")
    return R.similar_cases(c.withColumnRenamed("board", "case_id"), c.withColumnRenamed("board", "q_id"), 8.0, 3)


@add("chunk_text", "WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 700))::INT AS st FROM documents WHERE length(text) > 0) SELECT doc_id, (st / 700)::INT AS chunk, substring(text, st + 1, 800) AS part FROM s WHERE trim(regexp_replace(substring(text, st + 1, 800), '[\\x09-\\x0D]', ' ', 'g')) <> ''")
def chunks(s, d):
    return R.chunk_text(B.table(s, d, "documents").select("doc_id", "text"), "doc_id", 800, 100)


@add("topk_inner_product", "WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), y AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_dot_product(u.v, q.v), 9) AS score FROM u JOIN u q ON q.vec_id % 20 = 0 AND q.vec_id <> u.vec_id), z AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM y) SELECT query_id, vec_id, score, rank FROM z WHERE rank <= 5")
def topk(s, d):
    v = B.table(s, d, "embeddings").select("vec_id", "embedding")
    return R.topk_inner_product(v, v.filter("vec_id % 20 = 0"), 5)


@add("alarm_windows", sql("SELECT event_id, board, ts AS start, ts + to_seconds(CASE WHEN event_id % 3 = 0 THEN 5 ELSE greatest(1, event_id % 40) END) AS stop FROM ev", "ev"))
def alarm_windows(s, d):
    e = B.events(s, d)
    dur = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 40)
    return e.select("event_id", "board", F.col("ts").cast("timestamp_ntz").alias("start"), F.timestamp_micros(F.unix_micros("ts") + F.greatest(F.lit(1), F.coalesce(dur, F.lit(5))) * 1_000_000).cast("timestamp_ntz").alias("stop"))


@add("index_to_time", sql("SELECT board, t, TIMESTAMP '2024-01-01' + to_seconds(t * 2) AS at FROM metrics", "metrics"))
def index_to_time(s, d):
    return B.metrics(s, d).select("board", "t", F.timestamp_seconds(F.lit(1704067200) + F.col("t") * 2).cast("timestamp_ntz").alias("at"))


@add("ses_flag", sql(_SMOOTH + " SELECT board, sum(CASE WHEN smooth / 9 > 0.5 THEN 1 ELSE 0 END)::BIGINT AS ses FROM m GROUP BY board", "metrics"))
def ses(s, d):
    m = B.metrics(s, d).withColumn("bbe", F.col("bbe").cast("decimal(18,6)"))
    x = M.smooth(m).select("board", F.round(F.col("smooth").cast("double"), 6).alias("smooth"))
    return x.groupBy("board").agg(F.sum(S.ses_flag(F.col("smooth") / 9)).cast("long").alias("ses"))


@add("softplus_standardise", sql("SELECT board, t, round(ln(1 + exp(0.8 * (bbe - avg(bbe) OVER w) / (stddev_pop(bbe) OVER w + 1e-6))), 5) AS y FROM metrics WINDOW w AS (PARTITION BY board)", "metrics"))
def softplus(s, d):
    w = W.partitionBy("board")
    z = (F.col("bbe") - F.avg("bbe").over(w)) / (F.stddev_pop("bbe").over(w) + 1e-6)
    return B.metrics(s, d).select("board", "t", F.round(F.log1p(F.exp(z * 0.8)), 5).alias("y"))


@add("flow_chains", sql("WITH x AS (SELECT board, alarm, ts, event_id, value FROM ev) SELECT dense_rank() OVER (ORDER BY board, alarm)::INT AS chain, (row_number() OVER (PARTITION BY board, alarm ORDER BY ts, event_id))::INT AS step, event_id FROM x", "ev"))
def alarm_chains(s, d):
    e = B.events(s, d)
    keys = D.ranked(e.select("board", "alarm").distinct(), F.col("board"), F.col("alarm")).select("board", "alarm", F.col("k").cast("int").alias("chain"))
    w = W.partitionBy("board", "alarm").orderBy("ts", "event_id")
    return e.join(keys, ["board", "alarm"]).select("chain", F.row_number().over(w).alias("step"), "event_id")
