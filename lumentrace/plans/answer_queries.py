"""Answers of models: texts made of all events of a board and day, parsed, scored and rewarded in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.functions import scalars as S
from lumentrace.operators import evaluation as E
from lumentrace.operators import texts as X

from . import bindings as B
from . import evaluation_queries as EV
from .bindings import sql

Q: dict = {}
O: dict = {}  # noqa: E741

#: Columns of an alarm-flow row.
COLUMNS = "SourceBoard,SourceAlarm,SourceEvent,SourceStartTime,SourceDurationSec,SourceRole,PropToBoard,PropAlarm,PropEvent,PropRole,ArrivalTime,ClearTime,ViaEdgeType,Layer,Direction,Severity,DelayMs,DelaySec,RuleNote,RuleIdx,Hop,PrevBoard,RootCauseBoard,RootCauseEvent"


def add(name: str, oracle: str | None):
    def wrap(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return wrap


def answers(s, d):
    """One text per board and day that lists all its events, with rows too short and texts without marks or header among them; and its truth."""
    e = B.events(s, d).withColumn("id", F.col("board") * 1000 + F.dayofyear("ts"))
    src = S.board_name(F.col("board") % 25, F.lit("OA"), F.col("board"))
    prop = S.board_name(F.col("event_id") % 9, F.lit("LINE"), F.col("event_id") % 40)
    palarm, sev = F.concat(F.upper("alarm"), F.lit("_AIS")), F.when(F.col("alarm").isin("click", "view"), "Minor").otherwise("Critical")
    few = F.concat_ws(",", src, "alarm", F.lit("broken"))
    ten = F.concat_ws(",", src, "alarm", F.lit("e,t,1,r"), prop, palarm, F.lit("e,x"))
    full = F.concat_ws(",", src, "alarm", F.lit("e,t,1,r"), prop, palarm, F.lit("e,r,a,c,v,l,d"), sev, F.lit("0,0,n,1"), (F.col("event_id") % 5).cast("string"), F.lit("p"), src, F.lit("x"))
    row = F.when(F.col("event_id") % 7 == 0, few).when(F.col("event_id") % 11 == 0, ten).otherwise(full)
    g = e.groupBy("id", "board").agg(
        F.sort_array(F.collect_list(F.struct("event_id", row.alias("row"), prop.alias("prop"), palarm.alias("alarm"), sev.alias("sev")))).alias("x"), F.count(F.lit(1)).cast("int").alias("gt_rows")
    )
    body = F.array_join(F.transform("x", lambda t: t["row"]), "\n")
    names = F.array(*[F.lit(x) for x in S.EVENTS])
    event = lambda k: F.element_at(names, (k % 7 + 1).cast("int"))
    intro = F.when(F.col("id") % 6 == 0, "Nothing is named.\n").otherwise(
        F.concat(F.lit("Event: "), event(F.col("id")), F.when(F.col("id") % 4 == 0, F.concat(F.lit("\nEvent: "), event(F.col("board") + 1))).otherwise(""), F.lit("\nBoard: "), src, F.lit("\n"))
    )
    k = F.col("id") % 5
    mark = F.when(k == 0, f"alarm_flow rows (CSV):\n{COLUMNS}\n").when(k == 1, f"alarm_flow rows:\n{COLUMNS}\n").when(k == 2, "Predicted alarm_flow\n").when(k == 3, f"{COLUMNS}\n").otherwise("")
    tail = F.when(k == 1, "\n\n\nfurther, words").when(k == 3, "").otherwise("\nRCA reasoning: a, b")
    gt = event(F.col("board"))
    return g.select(
        F.col("id").alias("sample_index"), F.concat(intro, mark, body, tail).alias("text"), gt.alias("gt_event"), src.alias("gt_board"),
        F.array_distinct(F.transform("x", lambda t: t["prop"])).alias("gt_boards"), F.transform("x", lambda t: t["alarm"]).alias("gt_alarms"), F.transform("x", lambda t: t["sev"]).alias("gt_severities"),
        "gt_rows", (F.col("id") % 3 + 1).cast("int").alias("n_failures"), F.array_distinct(F.array(gt, event(F.col("board") + 1))).alias("gt_root_events"),
    )


_NAMES = "[" + ", ".join(f"'{e}'" for e in S.EVENTS) + "]"


def _name(node: str, kind: str, index: str) -> str:
    return f"'ROADM' || ({node}) || '-{kind}' || CASE WHEN ({index}) < 1000 THEN lpad(({index})::VARCHAR, 3, '0') ELSE ({index})::VARCHAR END || '$0'"


B.CTES["rows_said"] = (
    ("ev",),
    f"""SELECT *, CASE WHEN event_id % 7 = 0 THEN src || ',' || alarm || ',broken' WHEN event_id % 11 = 0 THEN src || ',' || alarm || ',e,t,1,r,' || prop || ',' || palarm || ',e,x'
ELSE src || ',' || alarm || ',e,t,1,r,' || prop || ',' || palarm || ',e,r,a,c,v,l,d,' || sev || ',0,0,n,1,' || (event_id % 5) || ',p,' || src || ',x' END AS row FROM (
SELECT *, board * 1000 + dayofyear(ts) AS id, {_name("board % 25", "OA", "board")} AS src, {_name("event_id % 9", "LINE", "event_id % 40")} AS prop, upper(alarm) || '_AIS' AS palarm, CASE WHEN alarm IN ('click', 'view') THEN 'Minor' ELSE 'Critical' END AS sev FROM ev)""",
)
B.CTES["answers"] = (
    ("rows_said",),
    f"""SELECT id AS sample_index, board, CASE WHEN id % 6 = 0 THEN 'Nothing is named.' || chr(10) ELSE 'Event: ' || {_NAMES}[(id % 7 + 1)::INT] || CASE WHEN id % 4 = 0 THEN chr(10) || 'Event: ' || {_NAMES}[((board + 1) % 7 + 1)::INT] ELSE '' END || chr(10) || 'Board: ' || src || chr(10) END
|| CASE id % 5 WHEN 0 THEN 'alarm_flow rows (CSV):' || chr(10) || '{COLUMNS}' || chr(10) WHEN 1 THEN 'alarm_flow rows:' || chr(10) || '{COLUMNS}' || chr(10) WHEN 2 THEN 'Predicted alarm_flow' || chr(10) WHEN 3 THEN '{COLUMNS}' || chr(10) ELSE '' END || body
|| CASE id % 5 WHEN 1 THEN chr(10) || chr(10) || chr(10) || 'further, words' WHEN 3 THEN '' ELSE chr(10) || 'RCA reasoning: a, b' END AS text, {_NAMES}[(board % 7 + 1)::INT] AS gt_event, src AS gt_board, gt_boards, gt_alarms, gt_severities, gt_rows, (id % 3 + 1)::INT AS n_failures,
list_distinct([{_NAMES}[(board % 7 + 1)::INT], {_NAMES}[((board + 1) % 7 + 1)::INT]]) AS gt_root_events
FROM (SELECT id, board, min(src) AS src, string_agg(row, chr(10) ORDER BY event_id) AS body, list_distinct(list(prop)) AS gt_boards, list(palarm) AS gt_alarms, list(sev) AS gt_severities, count(*)::INT AS gt_rows FROM rows_said GROUP BY id, board)""",
)


def _sql_text(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


def _commas(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ',', '')))"


_ENDS = "[" + ", ".join(f"instr(rest, {_sql_text(e)})" for e in X.END_MARKS) + "]"
_REST = "CASE " + " ".join(f"WHEN contains(text, '{m}') THEN substring(text, instr(text, '{m}') + {len(m)})" for m in X.START_MARKS) + " END"
_SPLIT = "list_filter(list_transform(string_split({}, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '')"


def _column(name: str) -> str:
    return f"list_transform(fields, lambda f: coalesce(trim(f[list_position(header, '{name}')]), ''))"


#: Every answer with its table's lines, header, fields and the columns that are scored.
B.CTES["parsed"] = (
    ("answers",),
    f"""SELECT *, {_column("PropToBoard")} AS props, {_column("SourceBoard")} AS sources, list_filter({_column("PropAlarm")}, lambda v: v <> '') AS alarms, list_filter({_column("Severity")}, lambda v: v <> '') AS severities FROM (
SELECT *, list_filter(list_transform(lines[2:], lambda l: string_split(l, ',')), lambda f: len(f) >= least(len(header), 6)) AS fields FROM (
SELECT *, list_transform(string_split(coalesce(lines[1], ''), ','), lambda h: trim(h)) AS header FROM (
SELECT *, {_SPLIT.format("block")} AS lines FROM (
SELECT *, CASE WHEN rest IS NULL THEN array_to_string(list_filter(string_split(text, chr(10)), lambda l: {_commas("l")} >= {X.FULL_ROW}), chr(10)) ELSE left(rest, coalesce(list_min(list_filter({_ENDS}, lambda i: i > 1)) - 1, length(rest))) END AS block
FROM (SELECT *, {_REST} AS rest FROM answers)))))""",
)


@add("parse_csv_rows", sql("WITH x AS (SELECT sample_index, header, unnest(fields) AS f, unnest(range(len(fields))) AS n FROM parsed), y AS (SELECT sample_index, n::INT AS n, unnest(header[:len(f)]) AS \"column\", unnest(f[:len(header)]) AS value FROM x) SELECT sample_index, n, \"column\", trim(value) AS value FROM y", "parsed"))
def csv_rows(s, d):
    return X.csv_rows(answers(s, d).select("sample_index", X.csv_block(F.col("text")).alias("block")), "sample_index", "block")


def _lines(s, d):
    return answers(s, d).withColumn("lines", X.csv_lines(X.csv_block(F.col("text"))))


@add("alarm_counts_from_csv", sql("SELECT sample_index, alarm, count(*) AS n FROM (SELECT sample_index, unnest(alarms) AS alarm FROM parsed) GROUP BY 1, 2", "parsed"))
def csv_counts(s, d):
    x = _lines(s, d).select("sample_index", F.explode(X.table_values(F.col("lines"), "PropAlarm")).alias("alarm"))
    return x.groupBy("sample_index", "alarm").agg(F.count(F.lit(1)).alias("n"))


@add("severity_counts_from_csv", sql("SELECT sample_index, severity, count(*) AS n FROM (SELECT sample_index, unnest(severities) AS severity FROM parsed) GROUP BY 1, 2", "parsed"))
def csv_severities(s, d):
    x = _lines(s, d).select("sample_index", F.explode(X.table_values(F.col("lines"), "Severity")).alias("severity"))
    return x.groupBy("sample_index", "severity").agg(F.count(F.lit(1)).alias("n"))


@add("boards_from_csv", sql("SELECT DISTINCT sample_index, board FROM (SELECT sample_index, unnest(props || sources) AS board FROM parsed) WHERE board LIKE 'ROADM%'", "parsed"))
def csv_boards(s, d):
    return _lines(s, d).select("sample_index", F.explode(X.table_boards(F.col("lines"))).alias("board"))


@add("max_hop_from_csv", sql(f"SELECT sample_index, max(hop) AS max_hop FROM (SELECT sample_index, unnest(list_transform({_column('Hop')}, lambda h: try_cast(h AS INT))) AS hop FROM parsed) GROUP BY 1", "parsed"))
def csv_hops(s, d):
    hops = F.transform(X.csv_column(F.col("lines"), "Hop"), lambda h: h.try_cast("int"))
    return _lines(s, d).select("sample_index", F.explode(hops).alias("hop")).groupBy("sample_index").agg(F.max("hop").alias("max_hop"))


_FULL = f"list_filter({{}}, lambda l: {_commas('l')} >= {X.FULL_ROW})"


def _score(head: str, wide: str, weights: tuple[float, float, float]) -> str:
    data = f"CASE WHEN {wide} THEN lines[2:] ELSE lines END"
    n, good = f"len({data})", f"len({_FULL.format(data)})"
    return f"CASE WHEN len(lines) = 0 THEN 0.0 ELSE {weights[0]} * ({head}) + CASE WHEN {n} > 0 THEN {weights[1]} * {good} / {n} ELSE 0.0 END + CASE WHEN {n} > 0 AND gt_rows > 0 THEN {weights[2]} * least({n}, gt_rows) / greatest({n}, gt_rows) ELSE 0.0 END END"


_WIDE = f"{_commas('lines[1]')} >= {X.FULL_ROW}"
_BOTH = f"({_WIDE} AND contains(lines[1], 'SourceBoard'))"
_FORMAT = _score(f"CASE WHEN {_BOTH} THEN 1.0 ELSE 0.0 END", _BOTH, (0.25, 0.5, 0.25))
_COVERAGE = "(" + " + ".join(f"contains(upper(lines[1]), '{h.upper()}')::INT" for h in X.HEADER) + ") / 9"


@add("format_score", sql(f"SELECT sample_index, round({_FORMAT}, 9) AS score FROM parsed", "parsed"))
def format_score(s, d):
    return _lines(s, d).select("sample_index", F.round(X.format_score(F.col("lines"), F.col("gt_rows")), 9).alias("score"))


@add("header_coverage", sql(f"SELECT sample_index, coalesce({_COVERAGE}, 0.0) AS share FROM parsed", "parsed"))
def header_coverage(s, d):
    return _lines(s, d).select("sample_index", X.header_coverage(F.coalesce(F.get("lines", F.lit(0)), F.lit(""))).alias("share"))


@add("reward_format", sql(f"SELECT sample_index, round({_score(f'CASE WHEN {_BOTH} THEN 1.0 ELSE 0.0 END', _WIDE, (0.05, 0.10, 0.05))}, 9) AS plain, round({_score(_COVERAGE, _WIDE, (0.05, 0.10, 0.05))}, 9) AS smooth FROM parsed", "parsed"))
def format_reward(s, d):
    lines, n = F.col("lines"), F.col("gt_rows")
    return _lines(s, d).select("sample_index", F.round(X.format_reward(lines, n), 9).alias("plain"), F.round(X.format_reward(lines, n, smooth=True), 9).alias("smooth"))


def _overlap(a: str, b: str) -> str:
    kinds = f"list_distinct({a} || {b})"
    times = lambda of: f"len(list_filter({of}, lambda v: v = k))"
    part = lambda f: f"list_sum(list_transform({kinds}, lambda k: {f}({times(a)}, {times(b)})))"
    return f"CASE WHEN len({kinds}) = 0 THEN 1.0 ELSE {part('least')} / {part('greatest')} END"


_FOUND = "list_distinct(list_filter(props, lambda b: starts_with(b, 'ROADM')))"
_TABLE = f"""0.25 * CASE WHEN len(gt_boards) > 0 AND len({_FOUND}) > 0 THEN len(list_intersect({_FOUND}, gt_boards)) / len(list_distinct({_FOUND} || gt_boards)) WHEN len(gt_boards) = 0 AND len({_FOUND}) = 0 THEN 1.0 ELSE 0.0 END + CASE WHEN len(alarms) + len(gt_alarms) > 0 THEN 0.15 * ({_overlap("alarms", "gt_alarms")}) ELSE 0.0 END"""
_EVENT = f"""CASE WHEN contains(upper(text), replace(upper(gt_event), '_', ' ')) OR contains(upper(text), upper(gt_event)) THEN 0.25 WHEN regexp_extract(upper(text), '{X.EVENT_NAMES}', 1) <> ''
THEN CASE WHEN regexp_extract(regexp_extract(upper(text), '{X.EVENT_NAMES}', 1), '^([^_ ]*)', 1) = string_split(upper(gt_event), '_')[1] THEN 0.10 ELSE 0.0 END WHEN contains(upper(text), string_split(upper(gt_event), '_')[1]) THEN 0.03 ELSE 0.0 END"""
_BOARD = "CASE WHEN contains(text, gt_board) THEN 0.15 WHEN contains(text, regexp_extract(gt_board, '^([^-]*)-', 1)) THEN 0.05 ELSE 0.0 END"


@add("reward_discrete", sql(f"SELECT sample_index, round({_EVENT} + {_BOARD} + {_TABLE}, 9) AS reward FROM parsed", "parsed"))
def reward(s, d):
    a = _lines(s, d)
    total = X.event_reward(F.col("text"), F.col("gt_event")) + X.board_reward(F.col("text"), F.col("gt_board")) + X.table_reward(F.col("lines"), F.col("gt_boards"), F.col("gt_alarms"))
    return a.select("sample_index", F.round(total, 9).alias("reward"))


@add("reward_continuous", None)
def reward_smooth(s, d):
    """Both continuous rewards: that of the content, by likeness, and that of the form, by the header's covered share."""
    a = _lines(s, d).withColumns({"e": X.event_similarity(F.col("text"), F.col("gt_event")), "b": X.board_similarity(F.col("text"), F.col("gt_board"))})
    content = 0.25 * F.col("e") + 0.15 * F.col("b") + X.table_reward(F.col("lines"), F.col("gt_boards"), F.col("gt_alarms"))
    return a.select("sample_index", F.round(content, 9).alias("reward"), F.round(X.format_reward(F.col("lines"), F.col("gt_rows"), smooth=True), 9).alias("format_reward"))


_ALL = "list_distinct(list_filter(regexp_extract_all(text, 'Event:\\s*([A-Za-z_]+)', 1), lambda e: list_contains(" + _NAMES + ", e)))"
_CAT = "CASE WHEN list_contains(" + _NAMES + ", {0}) THEN string_split({0}, '_')[1] ELSE '' END"
B.CTES["example_rows"] = (
    ("parsed",),
    f"""SELECT sample_index, gt_event, gt_board, {_CAT.format("gt_event")} AS gt_category, pred_event, pred_board, {_CAT.format("pred_event")} AS pred_category, event_correct, board_correct,
(pred_event <> '' AND {_CAT.format("pred_event")} = {_CAT.format("gt_event")})::INT AS category_correct, round(f1, 4) AS board_f1, round(p, 4) AS board_precision, round(r, 4) AS board_recall, round(af, 4) AS alarm_f1, round(sf, 4) AS severity_f1, round(form, 4) AS format_score,
round(0.3 * event_correct + 0.2 * board_correct + 0.2 * f1 + 0.2 * af + 0.1 * form, 4) AS e2e_score, np AS pred_boards_count, nt AS gt_boards_count, len(list_distinct(alarms))::INT AS pred_alarm_types, len(list_distinct(gt_alarms))::INT AS gt_alarm_types, n_failures,
CASE WHEN n_failures > 1 THEN (len(list_intersect(named, gt_root_events)) = len(gt_root_events))::INT::DOUBLE END AS all_roots_identified, CASE WHEN n_failures > 1 THEN round(len(list_intersect(named, gt_root_events)) / len(gt_root_events), 4) END AS partial_root_accuracy,
CASE WHEN n_failures > 1 THEN round(CASE WHEN len(named) = 0 THEN 0.0 ELSE (len(named) - len(list_intersect(named, gt_root_events))) / len(named) END, 4) END AS false_positive_rate
FROM (SELECT *, (pred_event <> '' AND pred_event = gt_event)::INT AS event_correct, (pred_board <> '' AND pred_board = gt_board)::INT AS board_correct, CASE WHEN np = 0 OR nt = 0 THEN (np = nt)::INT ELSE shared / np END AS p, CASE WHEN np = 0 OR nt = 0 THEN (np = nt)::INT ELSE shared / nt END AS r, CASE WHEN np = 0 OR nt = 0 THEN (np = nt)::INT ELSE 2 * shared / (np + nt) END AS f1
FROM (SELECT *, len(said)::INT AS np, len(gt_boards)::INT AS nt, len(list_intersect(said, gt_boards)) AS shared FROM (SELECT *, list_distinct(list_filter(props || sources, lambda b: starts_with(b, 'ROADM'))) AS said, {_overlap("alarms", "gt_alarms")} AS af, {_overlap("severities", "gt_severities")} AS sf, {_FORMAT} AS form,
regexp_extract(text, 'Event: ([A-Za-z_]+)', 1) AS pred_event, CASE WHEN contains(text, 'Board: ') THEN regexp_extract(text, 'Board: (ROADM\\d+-\\w+\\$\\d+)', 1) ELSE regexp_extract(text, '(ROADM\\d+-\\w+\\$\\d+)', 1) END AS pred_board, {_ALL} AS named FROM parsed)))""",
)


@add("per_example", sql("SELECT * FROM example_rows", "example_rows"))
def per_example(s, d):
    return X.per_example(answers(s, d))


_MEANS = {"event_accuracy": "event_correct", "board_accuracy": "board_correct", "category_accuracy": "category_correct", "board_f1_mean": "board_f1", "alarm_f1_mean": "alarm_f1", "severity_f1_mean": "severity_f1", "format_score_mean": "format_score", "e2e_score_mean": "e2e_score", "all_roots_identified": "all_roots_identified", "partial_root_accuracy": "partial_root_accuracy"}


@add("example_summary", sql("SELECT n_failures, count(*) AS n_examples, count(all_roots_identified) AS n_multi_failure, " + ", ".join(f"round(avg({c}), 4) AS {n}" for n, c in _MEANS.items()) + " FROM example_rows GROUP BY n_failures", "example_rows"))
def example_summary(s, d):
    return E.example_summary(X.per_example(answers(s, d)), "n_failures")


@add("group_advantage_sizes", sql("SELECT sample, count(*) AS n FROM scores WHERE correct = 1 GROUP BY sample HAVING count(*) % 2 <> 0", "scores"))
def sizes(s, d):
    return E.uneven_groups(EV.scores(s, d).filter("correct = 1"), "sample", 2)


_RUNS = "WITH runs AS (SELECT 'clerk' || (o_custkey % 7) AS method, o_orderkey AS run, o_orderdate AS day, o_totalprice / 1000 AS price, o_orderkey % 11 - 2.0 AS score FROM orders), final AS (SELECT method, arg_max(price, (day, run)) AS price, arg_max(score, (day, run)) AS score FROM runs GROUP BY method), "


@add("main_results", _RUNS + "p AS (SELECT *, CASE method WHEN 'clerk3' THEN 0 WHEN 'clerk1' THEN 1 ELSE 2 END AS place FROM final), l AS (SELECT method, place, 'price' AS metric, price AS value FROM p UNION ALL SELECT method, place, 'score', score FROM p), t AS (SELECT metric, arg_min(method, (-value, place, method)) AS top FROM l GROUP BY metric) SELECT method, place, l.metric, value, method = top AND value > 0 AS best FROM l JOIN t ON l.metric = t.metric")
def main_results(s, d):
    o = B.table(s, d, "orders")
    runs = o.select(F.concat(F.lit("clerk"), (F.col("o_custkey") % 7).cast("string")).alias("method"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("at"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_orderkey") % 11 - 2.0).alias("score"))
    return E.main_results(runs, ["clerk3", "clerk1"], ["price", "score"])


@add(
    "training_curve",
    """WITH e AS (SELECT o_custkey AS run, o_orderkey AS step, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 1 THEN o_totalprice * 2 END AS reward, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS loss FROM orders)
SELECT * FROM e WHERE run IN (SELECT run FROM e WHERE reward IS NOT NULL OR loss IS NOT NULL)""",
)
def training_curve(s, d):
    k = F.col("o_orderkey")
    o = B.table(s, d, "orders").select(F.col("o_custkey").alias("run"), k.alias("step"), F.when(k % 3 == 0, F.col("o_totalprice")).alias("reward"), F.when(k % 3 == 1, F.col("o_totalprice") * 2).alias("reward_mean"), F.lit(None).cast("double").alias("mean_reward"), F.when(k % 5 > 0, k % 5).alias("loss"))
    return E.training_curve(o)


@add("multi_root_table", sql("SELECT method, " + ", ".join(f"round(avg(correct) FILTER (n_failures = {n}), 4) AS \"{n}\"" for n in (1, 2, 3)) + " FROM scores GROUP BY method", "scores"))
def multi_root_table(s, d):
    return E.per_count_table(EV.scores(s, d), [1, 2, 3])
