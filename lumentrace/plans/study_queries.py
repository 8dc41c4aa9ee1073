"""Tool calls, prompts, worked examples, dataset checks and remaining scalars over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.functions import scalars as S
from lumentrace.operators import preparation as D
from lumentrace.operators import quality as QC
from lumentrace.operators import rootcause as R
from lumentrace.operators import studies as U
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


# Traces: a customer's orders are the calls of one example.

TOOLS = ["get_metrics", "lookup_rule", "query_topology"]
B.CTES["traces"] = (
    (),
    f"""SELECT o_custkey AS id, o_custkey % 5 AS scenario, o_custkey % 2 AS correct, CASE WHEN o_custkey % 3 > 0 THEN count(*)::INT END AS steps, CASE WHEN o_custkey % 4 = 0 THEN count(*)::INT + 1 END AS calls,
string_agg('I think so.' || chr(10) || 'ACTION: ' || {TOOLS}[(o_orderkey % 3 + 1)::INT] || '(board_name="ROADM' || (o_orderkey % 9) || '-OA001$0", n=' || o_orderkey || ', x=' || (o_orderkey % 7) || '.5, bbe_range=(50, 60), ids=[1, 2], why=''a b'')', chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey""",
)


def traces(s, d):
    k = F.col("o_orderkey")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (k % 3 + 1).cast("int"))
    line = F.concat(
        F.lit("I think so.\nACTION: "), tool, F.lit('(board_name="ROADM'), (k % 9).cast("string"), F.lit('-OA001$0", n='), k.cast("string"), F.lit(", x="), (k % 7).cast("string"), F.lit(".5, bbe_range=(50, 60), ids=[1, 2], why='a b')")
    )
    g = B.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("x"), F.count(F.lit(1)).cast("int").alias("n"))
    return g.select(
        "id", (F.col("id") % 5).alias("scenario"), (F.col("id") % 2).alias("correct"), F.when(F.col("id") % 3 > 0, F.col("n")).alias("steps"), F.when(F.col("id") % 4 == 0, F.col("n") + 1).alias("calls"), F.array_join(F.transform("x", lambda t: t["line"]), "\n").alias("text")
    )


_ARGS = """SELECT id, step, tool, unnest([['board_name', 'ROADM' || (k % 9) || '-OA001$0', 'text'], ['n', k::VARCHAR, 'int'], ['x', (k % 7) || '.5', 'float'], ['bbe_range', '50, 60', 'tuple'], ['ids', '[1, 2]', 'list'], ['why', 'a b', 'text']]) AS a
FROM (SELECT o_custkey AS id, o_orderkey AS k, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS step, """ + f"{TOOLS}[(o_orderkey % 3 + 1)::INT] AS tool FROM orders)"


@add("parse_action", f"SELECT id, step, tool, a[1] AS key, a[2] AS value, a[3] AS type FROM ({_ARGS})")
def parse_action(s, d):
    return U.action_arguments(traces(s, d).select("id", "text"), "id")


_USAGE = "SELECT id, scenario, correct, coalesce(steps, 0) AS steps, coalesce(calls, len(t))::INT AS calls, array_to_string(list_sort(list_distinct(t)), ',') AS tools, array_to_string(t, '>') AS sequence FROM (SELECT *, regexp_extract_all(text, 'ACTION:\\s*(\\w+)\\(', 1) AS t FROM traces)"


def _usage(s, d):
    t = traces(s, d)
    return U.tool_usage(t, "id").join(t.select("id", "scenario", "correct"), "id")


@add("tool_usage", sql("SELECT id, steps, calls, tools, sequence FROM (" + _USAGE + ")", "traces"))
def tool_usage(s, d):
    return U.tool_usage(traces(s, d), "id")


@add("tool_usage_stats", sql(f"WITH u AS ({_USAGE}) SELECT 'all' AS part, count(*) AS n, avg(steps) AS avg_steps, avg(calls) AS avg_calls FROM u UNION ALL SELECT 'correct', count(*), avg(steps), avg(calls) FROM u WHERE correct = 1 UNION ALL SELECT 'wrong', count(*), avg(steps), avg(calls) FROM u WHERE correct = 0", "traces"))
def tool_usage_stats(s, d):
    return U.usage_stats(materialise(_usage(s, d), "usage"))


@add("tool_heatmap", sql(f"WITH u AS ({_USAGE}) SELECT scenario, " + ", ".join(f"avg(len(list_filter(string_split(sequence, '>'), lambda x: x = '{t}'))) AS {t}" for t in TOOLS) + " FROM u GROUP BY scenario", "traces"))
def tool_heatmap(s, d):
    return U.tool_heatmap(_usage(s, d), "scenario", TOOLS)


@add("tool_frequency", sql("SELECT tool, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'ACTION:\\s*(\\w+)\\(', 1)) AS tool FROM traces) GROUP BY tool", "traces"))
def tool_frequency(s, d):
    return traces(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(U.ACTION), F.lit(1))).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


# Prompts: a customer's orders are the paths of one prompt.

B.CTES["prompts"] = (
    (),
    """SELECT o_custkey AS id, CASE WHEN o_custkey % 4 > 0 THEN 'topology/lightpaths lines=' || count(*) || ' sample:' || chr(10) ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN 'note' || chr(10) ELSE '' END || string_agg('ROADM' || (o_orderkey % 9) || '-LINE' || o_orderkey || '$0,ROADM1-OA002$0', chr(10) ORDER BY o_orderkey)
|| chr(10) || 'end' || chr(10) || 'ROADM9-after' || chr(10) || 'pattern_features: burst_regions=' || count(*) || ' longest_burst_frac=0.' || (o_custkey % 10) || ' bbe_max=' || (o_custkey % 60) || '.5 es_frac=' || CASE WHEN o_custkey % 5 = 0 THEN 'none' ELSE '0.25' END || ' pattern_kind=step peak_board=ROADM'
|| (o_custkey % 9) || '-' || ['OA', 'XCON', 'LINE', 'QQ'][(o_custkey % 4 + 1)::INT] || '001$0 peak_node=ROADM' || (o_custkey % 9) AS text FROM orders GROUP BY o_custkey""",
)


def prompts(s, d):
    k, i = F.col("o_orderkey"), F.col("id")
    line = F.concat(F.lit("ROADM"), (k % 9).cast("string"), F.lit("-LINE"), k.cast("string"), F.lit("$0,ROADM1-OA002$0"))
    g = B.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("x"), F.count(F.lit(1)).cast("string").alias("n"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("OA", "XCON", "LINE", "QQ")]), (i % 4 + 1).cast("int"))
    node = (i % 9).cast("string")
    text = F.concat(
        F.when(i % 4 > 0, F.concat(F.lit("topology/lightpaths lines="), "n", F.lit(" sample:\n"))).otherwise(""), F.when(i % 3 == 0, "note\n").otherwise(""), F.array_join(F.transform("x", lambda t: t["line"]), "\n"),
        F.lit("\nend\nROADM9-after\npattern_features: burst_regions="), "n", F.lit(" longest_burst_frac=0."), (i % 10).cast("string"), F.lit(" bbe_max="), (i % 60).cast("string"), F.lit(".5 es_frac="), F.when(i % 5 == 0, "none").otherwise("0.25"),
        F.lit(" pattern_kind=step peak_board=ROADM"), node, F.lit("-"), kind, F.lit("001$0 peak_node=ROADM"), node,
    )
    return g.select("id", text.alias("text"))


@add("prompt_features", sql("SELECT id, (id % 60 + 0.5)::DOUBLE AS bbe_max, 'step' AS pattern_kind, regexp_extract(text, 'peak_board=([\\w\\-$]+)', 1) AS peak_board, 'ROADM' || (id % 9) AS peak_node, regexp_extract(text, 'burst_regions=(\\d+)', 1)::INT AS burst_regions, ('0.' || (id % 10))::DOUBLE AS longest_burst_frac, NULL::DOUBLE AS bber_bbe_ratio, CASE WHEN id % 5 > 0 THEN 0.25::DOUBLE END AS es_frac FROM prompts", "prompts"))
def prompt_features(s, d):
    return prompts(s, d).select("id", *[c.alias(n) for n, c in U.features_of_prompt(F.col("text")).items()])


_PATTERNS, _TYPES = ["ramp", "step", "step_recovery", "burst", "flat"], ["OA", "XCON", "LINE", "FIU", "TRIB", "QQ", "OD", "XCON"]
_TOLD = " ".join(f"WHEN category = '{c}' AND p = '{p}' THEN '{what}: {cause}'" for (c, p), (what, cause) in U.CAUSES.items())


@add(
    "reasoning_steps",
    f"""WITH o AS (SELECT o_orderkey AS id, {_TYPES}[(o_orderkey % 8 + 1)::INT] AS t, {_PATTERNS}[(o_orderkey // 8 % 5 + 1)::INT] AS p, 'ROADM' || (o_orderkey % 9) || '-' || {_TYPES}[(o_orderkey % 8 + 1)::INT] || '001$0' AS board FROM orders),
c AS (SELECT *, CASE WHEN t IN ('OA', 'FIU', 'OD') THEN 'Fiber' WHEN t = 'XCON' THEN 'XCON' WHEN t = 'QQ' THEN 'unknown' ELSE 'Line' END AS category FROM o),
l AS (SELECT id, CASE WHEN id % 7 = 0 THEN ['Step 1: no pattern features, so other evidence decides.', 'Conclusion: the alarms point to E' || id % 3 || '.'] ELSE list_filter([
'Step 1: the peak board ' || board || CASE WHEN category = 'unknown' THEN ' is of no known kind, so the series decides.' ELSE ' is a ' || t || ' board, category ' || category || '.' END,
CASE WHEN category <> 'unknown' THEN 'Step 2: pattern_kind=' || p || CASE WHEN id % 3 > 0 THEN ', burst_regions=' || id % 11 ELSE '' END || ' shows ' || CASE WHEN category = 'Line' THEN 'a line card that lost its signal: Line_Disconnect' {_TOLD} ELSE 'no usual pattern of ' || category || ', further features decide' END || '.' END,
'Step 3: bber_bbe_ratio=' || printf('%.2f', id % 4 + 0.125) || CASE WHEN id % 5 > 0 THEN ', es_frac=' || printf('%.4f', (id % 10) / 10.0) ELSE '' END || ', bbe_max=' || printf('%.1f', id % 60 + 0.25) || ' agree with E' || id % 3 || '.',
'Conclusion: E' || id % 3 || ' on board ' || board || '.'], lambda x: x IS NOT NULL) END AS lines FROM c) SELECT id, array_to_string(lines, chr(10)) AS reasoning FROM l""",
)
def reasoning_steps(s, d):
    k = F.col("o_orderkey")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    number = lambda c: c.cast("string")
    text = F.concat(
        F.lit("board bbe_max=99.0\npattern_features: "), F.when(k % 3 > 0, F.concat(F.lit("burst_regions="), number(k % 11))).otherwise(""), F.lit(" bbe_max="), number(k % 60), F.lit(".25 es_frac="), F.when(k % 5 > 0, F.concat(F.lit("0."), number(k % 10))).otherwise("none"),
        F.lit(" bber_bbe_ratio="), number(k % 4), F.lit(".125 pattern_kind="), pick(_PATTERNS, F.floor(k / 8)), F.lit(" peak_board=ROADM"), number(k % 9), F.lit("-"), pick(_TYPES, k), F.lit("001$0"),
    )
    summary = F.when(k % 7 == 0, "no features").otherwise(text)
    return B.table(s, d, "orders").select(k.alias("id"), F.array_join(U.reasoning_steps(summary, F.concat(F.lit("E"), number(k % 3))), "\n").alias("reasoning"))


@add("lightpath_lines", sql("SELECT o_custkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS n, 'ROADM' || (o_orderkey % 9) || '-LINE' || o_orderkey || '$0,ROADM1-OA002$0' AS line FROM orders WHERE o_custkey % 4 > 0"))
def lightpath_lines(s, d):
    return prompts(s, d).select("id", F.posexplode(U.prompt_paths(F.col("text"))).alias("n", "line"))


@add("triage", sql("SELECT id, regexp_extract(text, 'peak_board=([\\w\\-$]+)', 1) AS board, CASE id % 4 WHEN 0 THEN 'Fiber' WHEN 1 THEN 'XCON' WHEN 2 THEN 'Line' ELSE 'unknown' END AS route FROM prompts", "prompts"))
def triage(s, d):
    board, route = U.triage(F.col("text"))
    return prompts(s, d).select("id", board.alias("board"), route.alias("route"))


@add("parse_experiment_name", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN 'unknown' ELSE ['zero-shot', 'sft', 'grpo', 'agent'][(o_orderkey % 5 + 1)::INT] END AS method, CASE WHEN o_orderkey % 5 = 4 THEN 'other_dataset_a' WHEN o_orderkey % 3 = 2 THEN 'mine' ELSE 'dataset_b' END AS dataset, CASE WHEN o_orderkey % 5 < 4 AND o_orderkey % 3 = 1 THEN 'size_' || (o_orderkey % 7) END AS subdir FROM orders")
def experiment(s, d):
    k = F.col("o_orderkey")
    method = F.element_at(F.array(*[F.lit(x) for x in U.EXPERIMENT_METHODS]), F.least((k % 5 + 1).cast("int"), F.lit(4)))
    tail = F.when(k % 3 == 0, "_dataset_b").when(k % 3 == 1, F.concat(F.lit("_dataset_b_size_"), (k % 7).cast("string"))).otherwise("_mine")
    name = F.when(k % 5 == 4, "other_dataset_a").otherwise(F.concat(method, tail))
    return B.table(s, d, "orders").select(k.alias("id"), *[c.alias(n) for n, c in U.experiment_parts(name).items()])


@add("parse_step_seconds", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 50 + 1 WHEN 1 THEN greatest(1, (o_orderkey % 5000) // 1000) WHEN 2 THEN o_orderkey % 9 + 1 ELSE 1 END AS seconds, CASE WHEN o_orderkey % 4 < 3 THEN (o_orderkey % 60)::DOUBLE END AS number FROM orders")
def step_seconds(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat((k % 50 + 1).cast("string"), F.lit("s"))).when(k % 4 == 1, F.concat((k % 5000).cast("string"), F.lit("ms"))).when(k % 4 == 2, (k % 9 + 1).cast("string")).otherwise("soon")
    number = F.when(k % 4 < 3, (k % 60).cast("string")).otherwise("n/a")
    return B.table(s, d, "orders").select(k.alias("id"), S.parse_step_seconds(text).alias("seconds"), number.try_cast("double").alias("number"))


@add("alarm_layers", sql("SELECT board, CASE WHEN ftype LIKE '%OTUk%' THEN 'optical' ELSE 'electrical' END AS layer, CASE WHEN board % 4 = 0 THEN 2.0 WHEN board % 4 = 1 THEN 0.7 WHEN board % 4 = 2 AND kind LIKE 'REGEN%' THEN 0.1 ELSE 1.0 END AS gain FROM typed", "typed"))
def alarm_layers(s, d):
    t = T.typed_boards(B.boards(s, d), B.hops(s, d))
    alarm = F.element_at(F.array(*[F.lit(x) for x in ("ODUk_PM_AIS", "ODUk_PM_BDI", "OTUk_LOM", "ODUk_DEG")]), (F.col("board") % 4 + 1).cast("int"))
    return t.select("board", S.layer_of_type(F.col("ftype")).alias("layer"), S.alarm_gain(alarm, F.col("kind").startswith("REGEN")).alias("gain"))


@add("json_fields", "SELECT o_custkey AS id, list_sort(list_distinct(list(o_orderstatus)))[1] AS first, count(DISTINCT o_orderstatus)::INT AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1")
def json_fields(s, d):
    g = B.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_json(F.sort_array(F.collect_set("o_orderstatus"))).alias("names"), F.to_json(F.create_map(F.lit("O"), F.count_if(F.col("o_orderstatus") == "O"))).alias("counts"))
    x = g.select("id", F.from_json("names", "array<string>").alias("names"), F.from_json("counts", "map<string,long>").alias("counts"))
    return x.select("id", F.get("names", F.lit(0)).alias("first"), F.size("names").alias("n"), F.element_at("counts", "O").alias("open"))


_CATEGORY = "CASE WHEN kind IN ('OA','OD','OM','FIU','REGENIN','REGENOUT') THEN 'Fiber' WHEN kind = 'XCON' THEN 'XCON' ELSE 'Line' END"
_DRAW = "(board * 2654435761 + 9) % 1000003"
_POOL = "CASE " + " ".join(f"WHEN {_CATEGORY} = '{c}' THEN {list(p)}[({_DRAW} % {len(p)} + 1)::INT]" for c, p in U.EVENT_POOLS.items()) + " END"


@add("event_for_board", sql(f"SELECT board, {_POOL} AS event FROM boards", "boards"))
def event_for_board(s, d):
    return B.boards(s, d).select("board", U.event_for_board(F.col("kind"), F.col("board"), 9).alias("event"))


@add(
    "staggered_failures",
    sql(
        f"SELECT board, node, (row_number() OVER (ORDER BY {_DRAW}, board))::INT AS place, ((row_number() OVER (ORDER BY {_DRAW}, board) - 1) * 30)::INT AS offset_s FROM (SELECT * FROM boards WHERE board IN (SELECT board FROM ev WHERE alarm = 'error') QUALIFY row_number() OVER (PARTITION BY node ORDER BY {_DRAW}, board) = 1) ORDER BY {_DRAW}, board LIMIT 5",
        "boards",
        "ev",
    ),
)
def staggered(s, d):
    failed = B.boards(s, d).join(B.events(s, d).filter("alarm = 'error'").select("board").distinct(), "board", "left_semi")
    return U.staggered_picks(failed.select("board", "node"), 5, 30, 9)


@add("multi_failure_truth", sql("SELECT dayofyear(ts) AS run, string_agg(board, ',' ORDER BY ts, board, alarm || event_id) AS root_boards, string_agg(alarm || event_id, ',' ORDER BY ts, board, alarm || event_id) AS root_events, count(*) AS n_failures FROM ev WHERE alarm = 'error' GROUP BY 1", "ev"))
def multi_failure(s, d):
    e = B.events(s, d).filter("alarm = 'error'").select(F.dayofyear("ts").alias("run"), F.col("ts").alias("time"), "board", F.concat("alarm", F.col("event_id").cast("string")).alias("event"))
    return U.multi_failure_truth(e, "run")


@add("dimension_metadata", "SELECT o_orderkey AS ow, o_totalprice AS value, c_acctbal AS coverage FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer) ON o_custkey = c_custkey")
def dimension(s, d):
    ex = B.table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ow"), F.col("o_totalprice").alias("value"))
    lab = B.table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("coverage_fraction"))
    return U.dimension_metadata(ex, lab, "key", {"coverage_fraction": "coverage", "noise_ratio": "noise"}).drop("key")


@add(
    "mask_observation",
    sql(
        """WITH l AS (SELECT o_custkey AS id, o_orderkey, 'ROADM' || o_orderkey || '-OA001$0' AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey) AS top FROM orders),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey <> top, (i * 2654435761 + 3) % 1000003) <= greatest(1, floor(n * 0.4)) AS gone FROM l)
SELECT id, 'Boards:' || chr(10) || string_agg(CASE WHEN gone THEN '  [masked]' ELSE '  ' || b || ': bbe_max=1' END, chr(10) ORDER BY i) || chr(10) || 'pattern_features: (masked)' || chr(10) || 'Warning: ' || count(*) FILTER (gone) || ' boards masked' AS text FROM g GROUP BY id"""
    ),
)
def mask_observation(s, d):
    name = F.concat(F.lit("ROADM"), F.col("o_orderkey").cast("string"), F.lit("-OA001$0"))
    g = B.table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", name.alias("b")))).alias("x"), F.max_by(name, "o_orderkey").alias("peak"))
    body = F.array_join(F.transform("x", lambda t: F.concat(F.lit("  "), t["b"], F.lit(": bbe_max=1"))), "\n")
    return U.mask_observation(g.select("id", "peak", F.concat(F.lit("Boards:\n"), body, F.lit("\npattern_features: bbe_max=7 es_frac=1")).alias("text")), "id", 0.4, 3)


@add(
    "sft_example",
    sql(
        """SELECT board AS id, 'Observations:' || chr(10) || name || chr(10) || chr(10) || 'pattern_kind=step' || chr(10) || chr(10) || 'Rules:' || chr(10) || '- ' || kind || chr(10) || chr(10) || 'Task: name board, event and time of the root cause, predict the alarm flow, and explain.' AS user,
'Metric-based diagnosis:' || chr(10) || 'The peak board is a ' || """ + _CATEGORY + """ || ' board whose series rises once and stays.' || chr(10) || chr(10) || 'Root cause (predicted):' || chr(10) || '- Board: ' || name || chr(10) || '- Event: ' || """ + _POOL + """ || chr(10) || '- Time: t' || chr(10) || '- Severity: Critical' || chr(10) || chr(10)
|| 'Predicted alarm_flow rows (CSV):' || chr(10) || 'a,b' || chr(10) || chr(10) || 'RCA reasoning:' || chr(10) || '- Rules used:' || chr(10) || '- ' || kind || chr(10) || 'Fix ideas:' || chr(10) || '1) look' AS assistant FROM boards""",
        "boards",
    ),
)
def sft_example(s, d):
    from lumentrace.operators import texts as X

    b = B.boards(s, d)
    truth = b.select(
        F.col("board").alias("id"), F.col("name").alias("topology"), F.lit("pattern_kind=step").alias("features"), F.concat(F.lit("- "), "kind").alias("rules"), F.col("name").alias("board"), U.event_for_board(F.col("kind"), F.col("board"), 9).alias("event"),
        F.lit("t").alias("time"), F.lit("Critical").alias("severity"), X.reasoning_line(S.board_category(F.col("kind")), F.lit("step")).alias("reasoning"), F.lit("a,b").alias("rows"), F.lit("1) look").alias("fixes"),
    )
    return U.sft_examples(truth)


@add(
    "rank_hits_block",
    """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings), y AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_dot_product(u.v, q.v), 9) AS score FROM u JOIN u q ON q.vec_id % 20 = 0 AND q.vec_id <> u.vec_id),
z AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM y), h AS (SELECT query_id, rank, score, vec_id, trim(replace(text, chr(10), ' ')) AS t FROM z JOIN documents ON doc_id = vec_id WHERE rank <= 5)
SELECT query_id, string_agg('[' || rank || '] score=' || printf('%.4f', score) || ' path=' || vec_id || ' chunk=0' || chr(10) || '  ' || CASE WHEN length(t) > 280 THEN left(t, 280) || '...' ELSE t END, chr(10) ORDER BY rank) AS block FROM h GROUP BY query_id""",
)
def rank_hits_block(s, d):
    v = B.table(s, d, "embeddings").select("vec_id", "embedding")
    hits = R.topk_inner_product(v, v.filter("vec_id % 20 = 0"), 8).withColumn("score", F.round("score", 9))
    texts = B.table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return U.hits_block(hits.join(texts, "vec_id").withColumns({"path": F.col("vec_id"), "chunk": F.lit(0)}), "query_id", 5)


@add(
    "baseline_output",
    sql(
        f"""SELECT id, event, 'Root cause (predicted):' || chr(10) || '- Board: ' || board || chr(10) || '- Event: ' || event || chr(10) || 'alarm_flow rows (CSV):' || chr(10) || n || ' alarms' AS text FROM (SELECT p.id, regexp_extract(text, 'peak_board=([\\w\\-$]+)', 1) AS board, CASE p.id % 4 WHEN 0 THEN 'Fiber_Cut' WHEN 1 THEN 'XCON_Port_Down' WHEN 2 THEN 'Line_Disconnect'
ELSE 'unknown' END AS event, count(e.event_id) AS n FROM prompts p LEFT JOIN ev e ON e.board = p.id AND e.alarm <> 'error' GROUP BY p.id, text)""",
        "prompts",
        "ev",
    ),
)
def baseline_output(s, d):
    p = prompts(s, d)
    board, route = U.triage(F.col("text"))
    f = U.features_of_prompt(F.col("text"))
    event = F.when(route == "unknown", "unknown").otherwise(R.root_cause(route, f["pattern_kind"], f["bbe_max"]))
    n = B.events(s, d).filter("alarm <> 'error'").groupBy(F.col("board").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    x = p.select("id", board.alias("board"), event.alias("event")).join(n, "id", "left")
    text = F.concat(F.lit("Root cause (predicted):\n- Board: "), "board", F.lit("\n- Event: "), "event", F.lit("\nalarm_flow rows (CSV):\n"), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" alarms"))
    return x.select("id", "event", text.alias("text"))


# Checks: a day's events are a window.

LIMITS = QC.Limits(boards=(5, 500), nodes=(3, 25), degree=(1.8, 900.0), paths=(20, 80), avg_hops=2.5)


def _windows(s, d):
    e = B.events(s, d).withColumn("ow", F.dayofyear("ts"))
    bad = F.col("alarm") == "error"
    g = e.filter(bad).groupBy("ow").agg(F.min(F.struct("ts", "event_id", "board")).alias("x"), F.sort_array(F.collect_set("board")).alias("failed_boards"))
    days = e.select("ow").distinct().join(g, "ow", "left")
    labels = days.select("ow", F.when(F.col("ow") % 9 > 0, F.col("x.board")).alias("root_board"), F.when(F.col("ow") % 7 > 0, "Fiber_Cut").alias("root_event"), "failed_boards", (F.col("ow") % 3 + 1).alias("k"), (F.col("ow") % 4 / 4).alias("coverage_fraction"), (F.col("ow") % 2).alias("noise_ratio"))
    alarms = e.join(g.select("ow", F.col("x.board").alias("root_board")), "ow", "left").select(
        "ow", "board", "alarm", F.lit("Major").alias("severity"), F.when(bad & (F.col("event_id") % 5 > 0), 0).otherwise(1).alias("hop"), "root_board", (F.col("event_id") % 6 == 0).alias("is_fp"), F.when(bad, -1).otherwise(1).alias("rule_idx")
    )
    return labels, alarms, e.filter(~bad & (F.col("ow") % 11 > 0)).select("ow", "board", "value")


def _checked(s, d):
    hops, b = materialise(B.hops(s, d), "hops"), B.boards(s, d)
    edges = materialise(T.edges(hops), "edges")
    labels, alarms, metrics = _windows(s, d)
    parts = T.connected_components(edges, b, materialise)
    return QC.dataset_checks(b, edges, hops, parts, hops.select("path_id").distinct(), metrics, materialise(alarms, "alarms"), materialise(labels, "labels"), LIMITS)


_BAD = "alarm = 'error'"
B.CTES["days"] = (("ev",), "SELECT *, dayofyear(ts) AS ow FROM ev")
B.CTES["roots"] = (("days",), f"SELECT ow, min((ts, event_id, board))[3] AS root, list_distinct(list(board)) AS failed FROM days WHERE {_BAD} GROUP BY ow")
B.CTES["lab"] = (("days", "roots"), "SELECT d.ow, CASE WHEN d.ow % 9 > 0 THEN root END AS root_board, CASE WHEN d.ow % 7 > 0 THEN 'Fiber_Cut' END AS root_event, failed, d.ow % 3 + 1 AS k FROM (SELECT DISTINCT ow FROM days) d LEFT JOIN roots r ON r.ow = d.ow")
B.CTES["alm"] = (("days", "roots"), f"SELECT d.ow, board, CASE WHEN {_BAD} AND event_id % 5 > 0 THEN 0 ELSE 1 END AS hop, root AS root_board, event_id % 6 = 0 AS is_fp, CASE WHEN {_BAD} THEN -1 ELSE 1 END AS rule_idx FROM days d LEFT JOIN roots r ON r.ow = d.ow")
B.CTES["comp"] = (("boards", "edges"), "SELECT board, min(root) AS component FROM (WITH RECURSIVE e2 AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT board, board AS root FROM boards UNION SELECT e2.b, r.root FROM r JOIN e2 ON r.board = e2.a) SELECT * FROM r) GROUP BY board")
B.CTES["lens"] = (("hops",), "SELECT path_id, count(*) AS len FROM hops GROUP BY path_id")
_OFF = "(SELECT count(*) FROM boards WHERE board NOT IN (SELECT board FROM hops))"
_COV = "(SELECT avg((board IN (SELECT board FROM hops))::INT) FROM boards)"
_VALUES = [
    ("board_count", "(SELECT count(*) FROM boards)", "v BETWEEN 5 AND 500"), ("node_count", "(SELECT count(DISTINCT node) FROM boards)", "v BETWEEN 3 AND 25"), ("orphan_boards", "(SELECT count(*) FROM boards WHERE node IS NULL)", "v = 0"),
    ("connected_components", "(SELECT count(DISTINCT component) FROM comp)", "v = 1"), ("avg_degree", "(SELECT round(avg(d), 2) FROM (SELECT count(*) AS d FROM (SELECT src AS b FROM edges UNION ALL SELECT dst FROM edges) GROUP BY b))", "v BETWEEN 1.8 AND 900"),
    ("path_count", "(SELECT count(*) FROM lens)", "v BETWEEN 20 AND 80"), ("avg_path_hops", "(SELECT avg(len - 1) FROM lens WHERE len > 1)", "v >= 2.5"), ("path_coverage", _COV, "v >= 0.8"), ("boards_on_no_path", _OFF, "v = 0"), ("single_board_paths", "(SELECT count(*) FROM lens WHERE len <= 1)", "v = 0"),
    ("service_coverage", _COV, "v >= 0.95"), ("services", "(SELECT count(*) FROM lens)", "v > 0"), ("windows", "(SELECT count(*) FROM lab)", "v > 0"),
    ("windows_without_data", f"(SELECT count(*) FROM lab WHERE ow NOT IN (SELECT ow FROM days WHERE NOT {_BAD} AND ow % 11 > 0)) + (SELECT count(*) FROM lab WHERE ow NOT IN (SELECT ow FROM alm))", "v = 0"), ("metric_columns_missing", "0", "v = 0"), ("alarm_columns_missing", "0", "v = 0"),
    ("labels_without_root", "(SELECT count(*) FROM lab WHERE root_board IS NULL)", "v = 0"), ("labels_without_failed", "(SELECT count(*) FROM lab WHERE root_board IS NULL AND coalesce(len(failed), 0) = 0)", "v = 0"), ("regions_too_small", "(SELECT count(*) FROM lab WHERE k >= 2 AND coalesce(len(failed), 0) < 2)", "v = 0"),
    ("coverage_fractions", "(SELECT count(DISTINCT ow % 4) FROM lab)", "v > 0"), ("false_alarm_share", "(SELECT avg(is_fp::INT) FROM alm)", "v < 1"), ("labels_incomplete", "(SELECT count(*) FROM lab WHERE root_board IS NULL OR root_event IS NULL)", "v = 0"),
    ("failures_without_seed_or_strange_roots", "(SELECT count(*) FROM (SELECT ow, unnest(failed) AS board FROM lab EXCEPT SELECT ow, board FROM alm WHERE hop = 0)) + (SELECT count(*) FROM (SELECT ow, root_board FROM alm WHERE NOT is_fp AND root_board IS NOT NULL EXCEPT SELECT ow, unnest(failed) FROM lab))", "v = 0"),
    ("propagated_rows", "(SELECT count(*) FROM alm WHERE rule_idx >= 0)", "v > 0"),
]
_ROWS = " UNION ALL ".join(f"SELECT {i} AS no, '{n}' AS name, v AS value, {ok} AS ok, {str(i in QC.CORE).lower()} AS core FROM (SELECT ({v})::DOUBLE AS v)" for i, (n, v, ok) in enumerate(_VALUES, 1))
_TABLES = ("boards", "hops", "edges", "comp", "lens", "days", "lab", "alm")


@add("dataset_checks", sql(_ROWS, *_TABLES))
def dataset_checks(s, d):
    return _checked(s, d)


@add("dataset_score", sql(f"SELECT count(*) FILTER (ok) AS passed, count(*) AS total FROM ({_ROWS}) WHERE core", *_TABLES))
def dataset_score(s, d):
    return QC.core_score(_checked(s, d))


@add("ranked_draw", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY (o_orderkey * 2654435761 + 3) % 1000003, o_orderkey) AS k FROM orders")
def ranked_draw(s, d):
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    return D.ranked(o, D.draw(F.col("id"), 3), F.col("id")).select("id", "k")
