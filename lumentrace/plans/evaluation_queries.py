"""Evaluation, text extraction, dataset preparation and quality checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.functions import scalars as S
from lumentrace.operators import evaluation as E
from lumentrace.operators import preparation as D
from lumentrace.operators import quality as QC
from lumentrace.operators import topology as T

from . import bindings as B
from .bindings import sql

Q: dict = {}
O: dict = {}  # noqa: E741
METHODS = ["base", "bucket", "mod"]

B.CTES["scores"] = (
    (),
    """SELECT o_orderkey AS sample, method, o_orderpriority AS category, o_orderstatus AS truth, pred, CASE WHEN pred = o_orderstatus THEN 1 ELSE 0 END AS correct, o_orderkey % 3 + 1 AS n_failures
FROM (SELECT *, 'base' AS method, 'O' AS pred FROM orders UNION ALL SELECT *, 'bucket', CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END FROM orders
UNION ALL SELECT *, 'mod', CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE NULL END FROM orders)""",
)


def scores(s, d):
    o = B.table(s, d, "orders")
    base = F.lit("O")
    bucket = F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 300000, "O").otherwise("P")
    mod = F.when(F.col("o_orderkey") % 3 == 0, "F").when(F.col("o_orderkey") % 3 == 1, "O")
    preds = F.array(*[F.struct(F.lit(m).alias("method"), p.alias("pred")) for m, p in zip(METHODS, (base, bucket, mod), strict=True)])
    x = o.select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("truth"), (F.col("o_orderkey") % 3 + 1).alias("n_failures"), F.explode(preds).alias("p"))
    return x.select("sample", "p.method", "category", "truth", "p.pred", E.matches(F.col("p.pred"), F.col("truth")).alias("correct"), "n_failures")


def add(name: str, oracle: str | None):
    def wrap(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return wrap


@add("event_match", sql("SELECT sample, method, correct FROM scores", "scores"))
def event_match(s, d):
    return scores(s, d).select("sample", "method", "correct")


@add("summary_by_category", sql("SELECT category, count(*) AS n, avg(correct) AS accuracy, avg(correct) FILTER (n_failures > 1) AS multi_accuracy FROM scores GROUP BY category UNION ALL SELECT '(all)', count(*), avg(correct), avg(correct) FILTER (n_failures > 1) FROM scores", "scores"))
def summary(s, d):
    return E.summary(scores(s, d))


@add("confusion", sql("SELECT coalesce(truth, '(none)') AS truth, coalesce(pred, '(none)') AS pred, count(*) AS n FROM scores GROUP BY 1, 2", "scores"))
def confusion(s, d):
    return E.confusion(scores(s, d))


@add("confusion_wide", sql("SELECT l.truth, count(*) FILTER (pred = 'F') AS pred_f, count(*) FILTER (pred = 'O') AS pred_o, count(*) FILTER (pred = 'P') AS pred_p, count(*) FILTER (pred = 'X') AS pred_x FROM (VALUES ('F'), ('O'), ('P'), ('X')) l(truth) LEFT JOIN scores s ON l.truth = s.truth GROUP BY l.truth", "scores"))
def confusion_wide(s, d):
    return E.confusion_wide(scores(s, d), ["F", "O", "P", "X"])


@add("confusion_long", sql("SELECT l.truth, p.pred, count(s.sample) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) l(truth), (VALUES ('pred_f', 'F'), ('pred_o', 'O'), ('pred_p', 'P'), ('pred_x', 'X')) p(pred, v) LEFT JOIN scores s ON l.truth = s.truth AND s.pred = p.v GROUP BY 1, 2", "scores"))
def confusion_long(s, d):
    return E.confusion_wide(scores(s, d), ["F", "O", "P", "X"]).unpivot("truth", ["pred_f", "pred_o", "pred_p", "pred_x"], "pred", "n")


@add("top_confusions", sql("SELECT truth, coalesce(pred, '(none)') AS pred, count(*) AS n FROM scores WHERE truth IS NOT NULL AND truth <> coalesce(pred, '(none)') GROUP BY 1, 2 ORDER BY n DESC, truth, pred LIMIT 10", "scores"))
def top_confusions(s, d):
    return E.top_confusions(scores(s, d), 10)


@add("compare_methods", sql("SELECT method, count(*) AS n, avg(correct) AS accuracy, sum(correct)::BIGINT AS hits FROM scores GROUP BY method", "scores"))
def compare(s, d):
    return E.compare_methods(scores(s, d))


@add("difficulty", sql("SELECT sample, sum(correct)::INT AS solved, CASE sum(correct) WHEN 3 THEN 'easy' WHEN 0 THEN 'impossible' WHEN 1 THEN 'hard' ELSE 'medium' END AS difficulty FROM scores GROUP BY sample", "scores"))
def difficulty(s, d):
    return E.difficulty(scores(s, d), METHODS)


@add("advantage", sql("WITH g AS (SELECT sample, max(correct) FILTER (method = 'mod') AS own, sum(correct) FILTER (method <> 'mod') AS others, count(*) FILTER (method <> 'mod') AS n FROM scores GROUP BY sample) SELECT count(*) FILTER (own = 1 AND others = 0) AS only_right, count(*) FILTER (own = 0 AND others = n) AS only_wrong, count(*) FILTER (own = 1 AND others = 0) - count(*) FILTER (own = 0 AND others = n) AS net FROM g", "scores"))
def advantage(s, d):
    return E.advantage(scores(s, d), "mod")


@add("method_dataset_pivot", sql("SELECT category, avg(correct) FILTER (method = 'base') AS base, avg(correct) FILTER (method = 'bucket') AS bucket, avg(correct) FILTER (method = 'mod') AS mod FROM scores GROUP BY category", "scores"))
def pivot(s, d):
    return E.method_pivot(scores(s, d), METHODS)


@add("per_event_accuracy", sql("SELECT method, truth, count(*) AS n, avg(correct) AS accuracy FROM scores GROUP BY 1, 2", "scores"))
def per_event(s, d):
    return scores(s, d).groupBy("method", "truth").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"))


@add("latest_run", "SELECT o_custkey AS model, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS score FROM orders GROUP BY 1")
def latest(s, d):
    o = B.table(s, d, "orders")
    return E.latest(o.select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("at")))


@add("best_per_row", sql("WITH g AS (SELECT category, method, avg(correct) AS accuracy FROM scores GROUP BY 1, 2 HAVING avg(correct) > 0) SELECT category, arg_min(method, (-accuracy, method)) AS best, max(accuracy) AS accuracy FROM g GROUP BY category", "scores"))
def best(s, d):
    return E.best_per_row(scores(s, d))


@add("iid_ood_delta", sql("SELECT method, coalesce(avg(correct) FILTER (sample % 2 = 0 AND method <> 'mod'), 0) AS iid, avg(correct) FILTER (sample % 2 = 1) AS ood, (avg(correct) FILTER (sample % 2 = 1) - coalesce(avg(correct) FILTER (sample % 2 = 0 AND method <> 'mod'), 0)) * 100 AS delta FROM scores GROUP BY method", "scores"))
def delta(s, d):
    x = scores(s, d).withColumn("split", F.when(F.col("sample") % 2 == 0, "iid").otherwise("ood")).filter("not (split = 'iid' and method = 'mod')")
    return E.split_delta(x)


@add("ablation_delta", sql("WITH x AS (SELECT category AS model, (CASE method WHEN 'base' THEN 1 WHEN 'mod' THEN 2 ELSE 3 END)::INT AS stage_no, avg(correct) AS score FROM scores GROUP BY 1, 2) SELECT *, score - lag(score) OVER (PARTITION BY model ORDER BY stage_no) AS delta FROM x", "scores"))
def ablation(s, d):
    no = F.when(F.col("method") == "base", 1).when(F.col("method") == "mod", 2).otherwise(3)
    return E.ablation_delta(scores(s, d).groupBy(F.col("category").alias("model"), no.alias("stage_no")).agg(F.avg("correct").alias("score")))


@add("group_advantage", "WITH r AS (SELECT l_orderkey AS prompt, l_linenumber, l_partkey, l_suppkey, l_discount AS reward FROM lineitem), w AS (SELECT *, avg(reward) OVER p AS mu, stddev_pop(reward) OVER p AS sd FROM r WINDOW p AS (PARTITION BY prompt)) SELECT prompt, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN sd < 1e-4 THEN 0 ELSE (reward - mu) / (sd + 1e-8) END, 5) + 0.0 AS advantage FROM w")
def group_adv(s, d):
    r = B.table(s, d, "lineitem").select(F.col("l_orderkey").alias("prompt"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("reward"))
    return E.group_advantage(r, "prompt").select("prompt", "l_linenumber", "l_partkey", "l_suppkey", (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


@add("promotion_gate", sql("SELECT category, method, avg(correct) >= 0.3 AND avg(correct) * 2 >= 0.60 AND avg(correct) + 0.3 >= 0.65 AND avg(correct) + 0.3 >= 0.7 AS promoted FROM scores GROUP BY 1, 2", "scores"))
def gate(s, d):
    a = F.avg("correct")
    m = scores(s, d).groupBy("category", "method").agg((a + 0.4).alias("event"), (a * 2).alias("board_f1"), (a + 0.3).alias("composite"))
    return E.promotion_gate(m.withColumn("baseline", F.lit(0.7))).select("category", "method", "promoted")


@add(
    "set_prf",
    """WITH a AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey)) AS p FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey)) AS t FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
j AS (SELECT o_orderkey AS id, coalesce(p, []) AS p, coalesce(t, []) AS t FROM orders LEFT JOIN a ON o_orderkey = a.id LEFT JOIN b ON o_orderkey = b.id), k AS (SELECT id, len(p) AS np, len(t) AS nt, len(list_intersect(p, t)) AS c FROM j)
SELECT id, CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 THEN 0.0 ELSE c / np END AS precision, CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 THEN 0.0 ELSE c / nt END AS recall,
round(CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN np = 0 OR nt = 0 OR c = 0 THEN 0.0 ELSE 2.0 * c / (np + nt) END, 9) AS f1 FROM k""",
)
def set_prf(s, d):
    li = B.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey"))).alias("p"), F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_suppkey"))).alias("t"))
    none = F.array().cast("array<bigint>")
    j = B.table(s, d, "orders").select(F.col("o_orderkey").alias("id")).join(li, "id", "left").select("id", F.coalesce("p", none).alias("p"), F.coalesce("t", none).alias("t"))
    m = E.set_prf(F.col("p"), F.col("t"))
    return j.select("id", m["precision"].alias("precision"), m["recall"].alias("recall"), F.round(m["f1"], 9).alias("f1"))


@add(
    "multiset_overlap",
    """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS board, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))) AS overlap FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY 1""",
)
def overlap(s, d):
    e = B.events(s, d)
    side = lambda r: e.filter(F.col("event_id") % 2 == r).groupBy("board", "alarm").agg(F.count(F.lit(1)).alias("n"))
    return E.multiset_overlap(side(0), side(1), ["board"], "alarm")


_TXT = "WITH x AS (SELECT *, CASE WHEN board % 4 = 0 THEN 'Root cause: ' || replace(ev, '_', ' ') || chr(10) || 'Board: ' || name WHEN board % 4 = 1 THEN 'we saw ' || lower(ev) || ' near ' || name WHEN board % 4 = 2 THEN 'nothing here' ELSE 'ACTION: get_metrics(board=\"' || name || '\")' || chr(10) || 'ACTION: lookup_rule(x=\"1\")' || chr(10) || 'ANSWER: Event: ' || ev || ' bbe_max=' || board || '.5, burst_regions=' || (board % 5) END AS text FROM (SELECT *, ['Fiber_Cut','XCON_Port_Down','Line_Disconnect'][(board % 3 + 1)::INT] AS ev FROM boards))"


def texts(s, d):
    b = B.boards(s, d).withColumn("ev", F.element_at(F.array(*[F.lit(e) for e in ("Fiber_Cut", "XCON_Port_Down", "Line_Disconnect")]), (F.col("board") % 3 + 1).cast("int")))
    k, name, ev = F.col("board") % 4, F.col("name"), F.col("ev")
    t = (
        F.when(k == 0, F.concat(F.lit("Root cause: "), F.replace(ev, F.lit("_"), F.lit(" ")), F.lit("\nBoard: "), name))
        .when(k == 1, F.concat(F.lit("we saw "), F.lower(ev), F.lit(" near "), name))
        .when(k == 2, F.lit("nothing here"))
        .otherwise(F.concat(F.lit('ACTION: get_metrics(board="'), name, F.lit('")\nACTION: lookup_rule(x="1")\nANSWER: Event: '), ev, F.lit(" bbe_max="), F.col("board").cast("string"), F.lit(".5, burst_regions="), (F.col("board") % 5).cast("string")))
    )
    return b.select("board", "name", "ev", t.alias("text"))


@add("extract_event", sql(_TXT + " SELECT board, CASE WHEN board % 4 = 2 THEN NULL ELSE ev END AS event FROM x", "boards"))
def extract_event(s, d):
    return texts(s, d).select("board", S.event_in_text(F.col("text")).alias("event"))


@add("extract_board", sql(_TXT + " SELECT board, nullif(regexp_extract(text, '(ROADM\\d+-\\w+\\$\\d+)', 1), '') AS found FROM x", "boards"))
def extract_board(s, d):
    return texts(s, d).select("board", S.board_in_text(F.col("text")).alias("found"))


@add("extract_answer", sql(_TXT + " SELECT board, trim(CASE WHEN contains(text, 'ANSWER:') THEN regexp_extract(text, '(?s)ANSWER:\\s*(.*)', 1) ELSE text END) AS answer FROM x", "boards"))
def extract_answer(s, d):
    return texts(s, d).select("board", S.answer_in_text(F.col("text")).alias("answer"))


@add("pattern_features_from_text", sql(_TXT + " SELECT board, CASE WHEN board % 4 = 3 THEN board + 0.5 END::DOUBLE AS bbe_max, CASE WHEN board % 4 = 3 THEN board % 5 END::INT AS burst_regions FROM x", "boards"))
def features(s, d):
    t = texts(s, d)
    return t.select("board", S.feature_in_text(F.col("text"), "bbe_max").try_cast("double").alias("bbe_max"), S.feature_in_text(F.col("text"), "burst_regions").try_cast("int").alias("burst_regions"))


@add("tool_sequence", sql(_TXT + ", y AS (SELECT board, regexp_extract_all(text, 'ACTION:\\s*(\\w+)\\(', 1) AS tools FROM x) SELECT board, (unnest(range(len(tools))))::INT AS step, unnest(tools) AS tool FROM y", "boards"))
def tools(s, d):
    return E.tool_calls(texts(s, d), "board")


@add("tool_usage_bins", "WITH c AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS calls, CASE WHEN count(*) % 2 = 0 THEN 1 ELSE 0 END AS correct FROM conversations GROUP BY conv_id) SELECT CASE WHEN calls < 2 THEN '0-1' WHEN calls < 4 THEN '2-3' WHEN calls < 6 THEN '4-5' ELSE '6+' END AS bin, count(*) AS n, avg(correct) AS accuracy FROM c GROUP BY 1")
def usage_bins(s, d):
    c = B.table(s, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("calls"), F.when(F.count(F.lit(1)) % 2 == 0, 1).otherwise(0).alias("correct"))
    return E.tool_usage_bins(c)


@add("parse_board", sql("SELECT name, 'ROADM' || node AS node, kind, board::INT AS index FROM boards", "boards"))
def parse_board(s, d):
    p = S.parse_board(F.col("name"))
    return B.boards(s, d).select("name", *[c.alias(k) for k, c in p.items()])


@add("scalar_functions", sql("SELECT board, kind || '-x' AS k, CASE WHEN kind IN ('OA','OD','OM','FIU','REGENIN','REGENOUT') THEN 'Fiber' WHEN kind = 'XCON' THEN 'XCON' ELSE 'Line' END AS category, CASE WHEN kind IN ('TRIB','XCON','LINE') THEN 'SRC' ELSE 'RELAY' END AS role, CASE WHEN (board + 3) % 4 < 2 THEN 1 ELSE 2 END AS side, least(node, domain) || '-' || greatest(node, domain) AS segment, lower(kind) || '-b' AS slug FROM boards", "boards"))
def scalar_functions(s, d):
    k = F.col("kind")
    return B.boards(s, d).select("board", F.concat(k, F.lit("-x")).alias("k"), S.board_category(k).alias("category"), S.role_for_kind(k).alias("role"), S.side_from_index(F.col("board")).alias("side"), S.segment_id(F.col("node"), F.col("domain")).alias("segment"), S.slug(F.concat(F.lit("--"), k, F.lit(" _ B!"))).alias("slug"))


@add("mask_boards", sql("WITH g AS (SELECT board, max(bbe) AS peak FROM metrics GROUP BY board), r AS (SELECT board, row_number() OVER (ORDER BY CASE WHEN board = (SELECT arg_max(board, (peak, -board)) FROM g) THEN 0 ELSE 1 END, (board * 2654435761 + 7) % 1000003, board) AS k, count(*) OVER () AS n FROM g) SELECT m.board, count(*) AS samples FROM metrics m WHERE m.board NOT IN (SELECT board FROM r WHERE k <= greatest(1, floor(n * 0.3))) GROUP BY m.board", "metrics"))
def mask_boards(s, d):
    return D.mask_boards(B.metrics(s, d), 0.3, 7).groupBy("board").agg(F.count(F.lit(1)).alias("samples"))


@add("train_val_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 2654435761 + 5) % 1000003, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= greatest(1, floor(n * 0.9)) AND k < n THEN 'train' ELSE 'val' END AS split FROM r")
def split(s, d):
    return D.train_val_split(B.table(s, d, "documents").select("doc_id"), "doc_id", 0.9, 5)


@add("inject_false_alarms", "WITH w AS (SELECT user_id AS ow, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), x AS (SELECT ow, n, unnest(range(1, floor(0.5 * greatest(1, n))::BIGINT + 1)) AS i FROM w) SELECT ow, i, (ow * 31 + i * 2654435761 + 3) % 1000003 % 100 + 1 AS board FROM x")
def inject(s, d):
    w = B.events(s, d).filter("alarm = 'error'").groupBy(F.col("board").alias("ow")).agg(F.count(F.lit(1)).alias("n"))
    return D.inject_false_alarms(w, 0.5, 100, 3)


@add("select_ids", "SELECT doc_id FROM documents WHERE doc_id BETWEEN 0 AND 9 OR doc_id = 12 OR doc_id BETWEEN 40 AND 44")
def select_ids(s, d):
    return D.select_ids(B.table(s, d, "documents").select("doc_id"), "doc_id", "0-9,12,40-44")


@add("trace_conversation", "SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS turns, count(*) AS steps, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id")
def conversation(s, d):
    return D.trace_conversation(B.table(s, d, "conversations"))


@add("resume_skip_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(s, d):
    return B.table(s, d, "documents").select("doc_id").join(B.table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@add("distinct_node_failures", sql("WITH f AS (SELECT DISTINCT e.board, node FROM ev e JOIN boards b ON e.board = b.board WHERE alarm = 'error'), r AS (SELECT board, node, row_number() OVER (PARTITION BY node ORDER BY (board * 2654435761 + 1) % 1000003, board) AS k FROM f) SELECT board, node FROM (SELECT *, row_number() OVER (ORDER BY (board * 2654435761 + 1) % 1000003, board) AS j FROM r WHERE k = 1) WHERE j <= 5", "ev", "boards"))
def node_failures(s, d):
    f = B.events(s, d).filter("alarm = 'error'").select("board").distinct().join(B.boards(s, d).select("board", "node"), "board")
    return D.pick_distinct_nodes(f, 5, 1)


@add("repeat_boost", sql("SELECT path_id, count(*) AS copies FROM (SELECT DISTINCT path_id, max(CASE WHEN node = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY path_id) AS hit FROM hops), range(3) r(i) WHERE i < 2 + hit GROUP BY path_id", "hops"))
def repeat_boost(s, d):
    p = B.hops(s, d).groupBy("path_id").agg(F.max(F.when(F.col("node") == 3, 1).otherwise(0)).alias("hit"))
    return p.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("hit") + 2))).groupBy("path_id").agg(F.count(F.lit(1)).alias("copies"))


@add("mask_uncovered", sql("WITH p AS (SELECT path_id, row_number() OVER (ORDER BY (path_id * 2654435761 + 2) % 1000003, path_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT path_id FROM hops)), kept AS (SELECT DISTINCT node FROM hops WHERE path_id IN (SELECT path_id FROM p WHERE k <= greatest(1, floor(n * 0.001)))) SELECT m.board, m.t, CASE WHEN b.node IN (SELECT node FROM kept) THEN bbe END AS bbe FROM metrics m JOIN boards b ON m.board = b.board", "hops", "metrics", "boards"))
def mask_uncovered(s, d):
    return D.mask_uncovered(B.hops(s, d), B.metrics(s, d), B.boards(s, d), 0.001, 2)


@add("dataset_fingerprint", "SELECT doc_id, sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || length(text)) AS fingerprint FROM documents")
def fingerprint(s, d):
    return D.fingerprint(B.table(s, d, "documents").withColumn("n", F.length("text")), "doc_id", ["lang", "source", "n"])


_CHECKS = """WITH c AS (SELECT 'boards' AS name, count(*) >= 100 AS ok FROM boards UNION ALL SELECT 'nodes', count(DISTINCT node) BETWEEN 5 AND 25 FROM boards
UNION ALL SELECT 'orphans', count(*) = 0 FROM boards WHERE node IS NULL UNION ALL SELECT 'paths', count(DISTINCT path_id) >= 20 FROM hops
UNION ALL SELECT 'avg_hops', avg(n) >= 3 FROM (SELECT path_id, count(*) AS n FROM hops GROUP BY 1) UNION ALL SELECT 'single_board_paths', count(*) = 0 FROM hops WHERE n = 1
UNION ALL SELECT 'coverage', count(DISTINCT h.board) >= 0.8 * count(DISTINCT b.board) FROM boards b LEFT JOIN hops h ON b.board = h.board
UNION ALL SELECT 'known_alarms', count(*) = 0 FROM ev WHERE board NOT IN (SELECT board FROM boards))"""


@add("quality_checks", sql(_CHECKS + " SELECT name, ok FROM c", "boards", "hops", "ev"))
def quality_checks(s, d):
    return QC.checks(B.boards(s, d), B.hops(s, d), B.events(s, d))


@add("scorecard", sql(_CHECKS + " SELECT count(*) FILTER (ok) AS passed, count(*) AS total FROM c", "boards", "hops", "ev"))
def scorecard(s, d):
    return QC.scorecard(QC.checks(B.boards(s, d), B.hops(s, d), B.events(s, d)))


@add("failed_without_seed", sql("SELECT DISTINCT board FROM ev WHERE alarm = 'error' AND board NOT IN (SELECT board FROM hops)", "ev", "hops"))
def failed_without_seed(s, d):
    return QC.without(B.events(s, d).filter("alarm = 'error'").select("board"), B.hops(s, d).select("board"))


@add("failure_distribution", sql("SELECT kind, alarm, string_agg(DISTINCT b.board::VARCHAR, ',' ORDER BY b.board::VARCHAR) AS boards FROM ev JOIN boards b ON ev.board = b.board GROUP BY kind, alarm", "ev", "boards"))
def failure_distribution(s, d):
    j = B.events(s, d).join(B.boards(s, d).select("board", "kind"), "board")
    return j.groupBy("kind", "alarm").agg(F.array_join(F.sort_array(F.collect_set(F.col("board").cast("string"))), ",").alias("boards"))


@add("fiber_groups", sql("SELECT least(src_node, dst_node) || '-' || greatest(src_node, dst_node) AS segment, count(DISTINCT path_id) AS n_paths, string_agg(DISTINCT src_kind, ',' ORDER BY src_kind) AS kinds FROM pairs WHERE src_node <> dst_node GROUP BY 1", "pairs"))
def fiber_groups(s, d):
    p = T.pairs(B.hops(s, d)).filter("src_node <> dst_node")
    return p.groupBy(S.segment_id(F.col("src_node"), F.col("dst_node")).alias("segment")).agg(F.countDistinct("path_id").alias("n_paths"), F.array_join(F.sort_array(F.collect_set("src_kind")), ",").alias("kinds"))


@add("failure_dedupe", sql("SELECT board, alarm, (value * 100)::BIGINT // 100 AS v, count(*) AS n FROM ev GROUP BY 1, 2, 3", "ev"))
def failure_dedupe(s, d):
    return B.events(s, d).groupBy("board", "alarm", F.floor(F.round(F.col("value") * 100) / 100).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@add("board_catalog_export", sql("WITH x AS (SELECT name, 'board' AS what FROM boards UNION SELECT DISTINCT least(src, dst) || '_' || greatest(src, dst), 'fibre' FROM edges WHERE src <> dst) SELECT name, what, (row_number() OVER (ORDER BY what, name))::INT AS id FROM x", "boards", "edges"))
def catalog_export(s, d):
    e = T.edges(B.hops(s, d)).filter("src <> dst")
    f = e.select(F.concat_ws("_", F.least("src", "dst"), F.greatest("src", "dst")).alias("name")).distinct().withColumn("what", F.lit("fibre"))
    x = B.boards(s, d).select("name", F.lit("board").alias("what")).unionByName(f)
    return D.ranked(x, F.col("what"), F.col("name")).select("name", "what", F.col("k").cast("int").alias("id"))
