"""Text, prompt, rule and further topology queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S
from lumentrace.operators import evaluation as E
from lumentrace.operators import preparation as D
from lumentrace.operators import series as M
from lumentrace.operators import texts as X
from lumentrace.operators import topology as T

from . import bindings as B
from . import evaluation_queries as EV
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


@add("normalize_board_id", sql("SELECT board, CASE WHEN kind LIKE 'REGEN%' THEN 'ROADM' || node || '-' || kind || lpad(board::VARCHAR, 5, '0') || '$0' ELSE name END AS fixed FROM boards", "boards"))
def normalize(s, d):
    b = B.boards(s, d)
    return b.select("board", S.normalize_board_id(F.concat(F.lit("ROADM"), F.col("node").cast("string"), F.lit("-"), "kind", F.col("board").cast("string"))).alias("fixed"))


@add("split_role", sql("SELECT path_id, pos, b.name AS board, h.role FROM hops h JOIN boards b ON h.board = b.board", "hops", "boards"))
def split_role(s, d):
    h = B.hops(s, d).join(B.boards(s, d).select("board", "name"), "board")
    token = F.when(F.col("role") == "", F.col("name")).otherwise(F.concat("name", F.lit("-"), "role"))
    board, role = S.split_role(token)
    return h.select("path_id", "pos", board.alias("board"), role.alias("role"))


@add("parse_ts_multi", sql("SELECT event_id, date_trunc('second', ts) AS at FROM ev", "ev"))
def parse_ts(s, d):
    e = B.events(s, d)
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(F.unix_seconds("ts").cast("string"))
    return e.select("event_id", S.parse_time(text).cast("timestamp_ntz").alias("at"))


@add("normalize_event_name", sql("SELECT board, ['Fiber_Cut','XCON_Port_Down','Line_Disconnect',NULL][(board % 4 + 1)::INT] AS event FROM boards", "boards"))
def normalize_event(s, d):
    k = F.col("board") % 4
    raw = F.when(k == 0, "fiber_cut").when(k == 1, "Port Down").when(k == 2, "DISCONNECT").otherwise("whatever")
    return B.boards(s, d).select("board", S.normalize_event(raw).alias("event"))


@add("extract_all_events", sql(EV._TXT + " SELECT board, CASE WHEN board % 4 = 2 THEN '' ELSE ev END AS events FROM x", "boards"))
def extract_all(s, d):
    return EV.texts(s, d).select("board", F.array_join(X.all_events(F.col("text")), ",").alias("events"))


@add("truncate_rows_text", "SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(string_split(text, chr(10))[1:3], chr(10)) || chr(10) || '(truncated ' || (len(string_split(text, chr(10))) - 3) || ' rows)' ELSE text END AS text FROM documents")
def truncate(s, d):
    return B.table(s, d, "documents").select("doc_id", X.truncate_rows(F.col("text"), 3).alias("text"))


@add("mask_prompt", "WITH x AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda v, i: CASE WHEN i % 4 = 0 THEN '[masked]' ELSE v END) AS l FROM documents) SELECT doc_id, array_to_string(l, chr(10)) || chr(10) || 'Warning: ' || len(list_filter(l, lambda v: v = '[masked]')) || ' lines masked' AS text FROM x")
def mask_prompt(s, d):
    return X.mask_lines(B.table(s, d, "documents").select("doc_id", "text"), "doc_id", 4)


@add("render_hits", "WITH u AS (SELECT doc_id, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS rank, source FROM documents) SELECT source, string_agg('[' || rank || '] ' || left(replace(text, chr(10), ' '), 280), chr(10) ORDER BY rank) AS block FROM u WHERE rank <= 5 GROUP BY source")
def render_hits(s, d):
    w = W.partitionBy("source").orderBy("doc_id")
    hits = B.table(s, d, "documents").select("source", "text", F.row_number().over(w).alias("rank")).filter("rank <= 5")
    return X.render_hits(hits, "source")


@add("translate_legacy_tokens", sql("WITH x AS (SELECT *, CASE WHEN (board + 3) % 4 < 2 THEN 1 ELSE 2 END AS side FROM hops) SELECT path_id, pos, CASE WHEN kind = 'LINE' THEN 'Line' || coalesce(lead(side) OVER w, lag(side) OVER w, 1) ELSE kind END AS token FROM x WINDOW w AS (PARTITION BY path_id ORDER BY pos)", "hops"))
def legacy(s, d):
    return X.translate_legacy(B.hops(s, d).withColumn("side", S.side_from_index(F.col("board"))))


@add("ow_prompt", sql("WITH f AS (SELECT b.node, m.board, max(bbe) AS bbe_max FROM metrics m JOIN boards b ON m.board = b.board GROUP BY 1, 2), t AS (SELECT node, arg_min(board, (-bbe_max, board)) AS board, max(bbe_max) AS peak FROM f GROUP BY node), c AS (SELECT node, string_agg(name, ',' ORDER BY name) AS boards FROM boards GROUP BY node) SELECT c.node, 'Boards: ' || boards || chr(10) || 'Peak board: ' || t.board || chr(10) || 'pattern_kind=' || CASE WHEN t.board % 2 = 0 THEN 'step' ELSE 'burst' END AS prompt FROM c JOIN t ON c.node = t.node", "metrics", "boards"))
def ow_prompt(s, d):
    b = B.boards(s, d)
    f = M.board_max(B.metrics(s, d)).join(b.select("board", "node"), "board").withColumn("pattern", F.when(F.col("board") % 2 == 0, "step").otherwise("burst"))
    return X.prompts(f, T.board_catalog(b))


@add("reasoning_lines", sql("SELECT board, 'The peak board is a ' || CASE WHEN kind IN ('OA','OD','OM','FIU','REGENIN','REGENOUT') THEN 'Fiber' WHEN kind = 'XCON' THEN 'XCON' ELSE 'Line' END || ' board whose series ' || CASE board % 4 WHEN 0 THEN 'rises once and stays' WHEN 1 THEN 'rises slowly to a narrow peak' WHEN 2 THEN 'stays high between spikes' ELSE 'falls back between peaks' END || '.' AS line FROM boards", "boards"))
def reasoning(s, d):
    k = F.col("board") % 4
    p = F.when(k == 0, "step").when(k == 1, "ramp").when(k == 2, "step_recovery").otherwise("burst")
    return B.boards(s, d).select("board", X.reasoning_line(S.board_category(F.col("kind")), p).alias("line"))


def _shortest(p):
    e = p.select(F.explode(F.array(F.struct(F.col("src_node").alias("a"), F.col("dst_node").alias("b")), F.struct(F.col("dst_node").alias("a"), F.col("src_node").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    one = e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("hops"))
    two = e.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").filter("a <> c").select(F.col("a").alias("src"), F.col("c").alias("dst"), F.lit(2).alias("hops"))
    return one.unionByName(two).groupBy("src", "dst").agg(F.min("hops").alias("hops"))


@add("bounded_shortest_path", sql("WITH n AS (SELECT DISTINCT least(src_node, dst_node) AS a, greatest(src_node, dst_node) AS b FROM pairs WHERE src_node <> dst_node), e AS (SELECT a, b FROM n UNION SELECT b, a FROM n), one AS (SELECT a AS src, b AS dst, 1 AS hops FROM e), two AS (SELECT x.a AS src, y.b AS dst, 2 AS hops FROM e x JOIN e y ON x.b = y.a WHERE x.a <> y.b) SELECT src, dst, min(hops) AS hops FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY src, dst", "pairs"))
def shortest_whole(s, d):
    return _shortest(T.pairs(B.hops(s, d)).filter("src_node <> dst_node"))


@add("partial_rules", sql("WITH r AS (SELECT *, CASE WHEN action LIKE 'Transmit%' THEN 0 ELSE 1 END AS c, (o_orderkey * 2654435761 + 3) % 1000003 AS h FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Transmit Up' ELSE 'Report Locally' END AS action FROM orders)), k AS (SELECT *, row_number() OVER (ORDER BY c DESC, h, o_orderkey) AS k, count(*) OVER () AS n FROM r) SELECT o_orderkey AS rule, action FROM k WHERE k <= floor(n * 0.5)"))
def partial_rules(s, d):
    r = B.table(s, d, "orders").select(F.col("o_orderkey").alias("rule"), F.when(F.col("o_orderkey") % 3 == 0, "Transmit Up").otherwise("Report Locally").alias("action"))
    kept = D.ranked(r, F.when(F.col("action").startswith("Transmit"), 1).otherwise(0), D.draw(F.col("rule"), 3), F.col("rule"))
    return kept.filter(F.col("k") <= F.floor(F.col("n") * 0.5)).select("rule", "action")


@add("filter_chain_pairs", sql("WITH t AS (SELECT DISTINCT a.alarm AS x, b.alarm AS y FROM ev a JOIN ev b ON a.board = b.board AND a.event_id + 1 = b.event_id AND a.value > 12), c AS (SELECT event_id, alarm AS x, lead(alarm) OVER (PARTITION BY board ORDER BY ts, event_id) AS y, value / 20 AS score FROM ev) SELECT event_id, x, y FROM c WHERE score > 0.5 AND (x, y) IN (SELECT x, y FROM t)", "ev"))
def chain_pairs(s, d):
    e = B.events(s, d)
    nxt = e.select("board", (F.col("event_id") - 1).alias("event_id"), F.col("alarm").alias("y"))
    truth = e.filter("value > 12").join(nxt, ["board", "event_id"]).select(F.col("alarm").alias("x"), "y").distinct()
    w = W.partitionBy("board").orderBy("ts", "event_id")
    c = e.select("event_id", F.col("alarm").alias("x"), F.lead("alarm").over(w).alias("y"), (F.col("value") / 20).alias("score"))
    return c.filter("score > 0.5").join(truth, ["x", "y"], "left_semi").select("event_id", "x", "y")


@add("multi_root_metrics", "WITH g AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey) FILTER (l_linenumber <= 2)) AS p, list_distinct(list(l_suppkey) FILTER (l_quantity > 20)) AS t FROM lineitem GROUP BY 1), x AS (SELECT id, coalesce(p, []) AS p, coalesce(t, []) AS t FROM g) SELECT id, CASE WHEN len(list_intersect(t, p)) = len(t) THEN 1 ELSE 0 END AS all_roots, CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_intersect(t, p)) / len(t) END AS partial, CASE WHEN len(p) = 0 THEN 0.0 ELSE (len(p) - len(list_intersect(t, p))) / len(p) END AS false_rate FROM x")
def multi_root(s, d):
    g = B.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey"))).alias("p"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_suppkey"))).alias("t"))
    both, p, t = F.size(F.array_intersect("p", "t")), F.size("p"), F.size("t")
    return g.select("id", F.when(both == t, 1).otherwise(0).alias("all_roots"), F.when(t == 0, 0.0).otherwise(both / t).alias("partial"), F.when(p == 0, 0.0).otherwise((p - both) / p).alias("false_rate"))


@add("sweep_curve", sql("SELECT regexp_extract(e, '(\\d+)$', 1)::INT AS level, method, avg(correct) AS accuracy FROM (SELECT *, 'noise_' || n_failures AS e FROM scores) GROUP BY 1, 2", "scores"))
def sweep(s, d):
    x = EV.scores(s, d).withColumn("e", F.concat(F.lit("noise_"), F.col("n_failures").cast("string")))
    return x.groupBy(F.regexp_extract("e", r"(\d+)$", 1).cast("int").alias("level"), "method").agg(F.avg("correct").alias("accuracy"))


@add("error_breakdown", sql("SELECT method, count(*) FILTER (pred IS NULL) AS missing, count(*) FILTER (pred <> truth) AS wrong, count(*) FILTER (correct = 0) * 100.0 / count(*) AS error_pct FROM scores GROUP BY method", "scores"))
def breakdown(s, d):
    n = F.count(F.lit(1))
    return EV.scores(s, d).groupBy("method").agg(F.count_if(F.col("pred").isNull()).alias("missing"), F.count_if(F.col("pred") != F.col("truth")).alias("wrong"), (F.count_if(F.col("correct") == 0) * 100.0 / n).alias("error_pct"))


@add("composite_score", sql("SELECT sample, method, round(0.3 * correct + 0.2 * (CASE WHEN sample % 2 = 0 THEN 1 ELSE 0 END) + 0.2 * (sample % 5) / 4.0 + 0.2 * (sample % 3) / 2.0 + 0.1, 9) AS score FROM scores", "scores"))
def composite(s, d):
    k = F.col("sample")
    c = E.composite(F.col("correct"), F.when(k % 2 == 0, 1).otherwise(0), k % 5 / 4.0, k % 3 / 2.0, F.lit(1.0))
    return EV.scores(s, d).select("sample", "method", F.round(c, 9).alias("score"))


@add("stress_matrix", sql("SELECT n_failures AS scenario, avg(correct) FILTER (method = 'base') AS base, avg(correct) FILTER (method = 'bucket') AS bucket, avg(correct) FILTER (method = 'mod') AS mod FROM scores GROUP BY 1", "scores"))
def stress(s, d):
    return EV.scores(s, d).groupBy(F.col("n_failures").alias("scenario")).pivot("method", EV.METHODS).agg(F.avg("correct"))


@add("top_sequences", "WITH g AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS sequence FROM conversations GROUP BY conv_id) SELECT sequence, count(*) AS n FROM g GROUP BY sequence ORDER BY n DESC, sequence LIMIT 10")
def sequences(s, d):
    g = B.table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    g = g.select(F.array_join(F.transform("x", lambda t: t["role"]), ">").alias("sequence"))
    return g.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sequence").limit(10)


@add("unused_endpoints", sql("WITH ends AS (SELECT DISTINCT board FROM hops WHERE pos = 1 OR pos = n), seen AS (SELECT DISTINCT board FROM metrics WHERE board % 9 IN (0, 2)) SELECT board, (row_number() OVER (ORDER BY board))::INT AS id FROM seen WHERE board NOT IN (SELECT board FROM ends)", "metrics", "hops"))
def unused(s, d):
    ends = B.hops(s, d).filter("pos = 1 or pos = n").select("board").distinct()
    seen = B.metrics(s, d).select("board").distinct().filter(B.kind_of(F.col("board")).isin("TRIB", "LINE"))
    return D.ranked(seen.join(ends, "board", "left_anti"), F.col("board")).select("board", F.col("k").cast("int").alias("id"))


@add("resolve_failure_location", sql("WITH q AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'b' || board ELSE board || '_' || (board + 1) END AS place, board FROM ev WHERE alarm = 'error') SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (SELECT name FROM boards b WHERE b.board = q.board) ELSE (SELECT 'fibre ' || least(q.board, q.board + 1) || '_' || greatest(q.board, q.board + 1) WHERE EXISTS (SELECT 1 FROM edges e WHERE (e.src = q.board AND e.dst = q.board + 1) OR (e.dst = q.board AND e.src = q.board + 1))) END AS element FROM q", "ev", "boards", "edges"))
def locate(s, d):
    q = B.events(s, d).filter("alarm = 'error'")
    place = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("b"), F.col("board").cast("string"))).otherwise(F.concat_ws("_", F.col("board").cast("string"), (F.col("board") + 1).cast("string")))
    q = q.select("event_id", place.alias("place"))
    e = T.edges(B.hops(s, d)).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    one = F.regexp_extract("place", r"^b(\d+)$", 1).try_cast("long")
    ends = [F.regexp_extract("place", r"^(\d+)_(\d+)$", i).try_cast("long") for i in (1, 2)]
    q = q.withColumns({"one": one, "a": F.least(*ends), "b": F.greatest(*ends)})
    q = q.join(B.boards(s, d).select(F.col("board").alias("one"), "name"), "one", "left").join(e.withColumn("fibre", F.concat(F.lit("fibre "), F.concat_ws("_", "a", "b"))), ["a", "b"], "left")
    return q.select("event_id", F.coalesce("name", "fibre").alias("element"))
