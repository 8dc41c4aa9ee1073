"""Examples for training and study: prompts and worked answers, tool calls and their use, truths of several failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S

from .preparation import draw

#: Events by the kind of board, in the order they are drawn from.
EVENT_POOLS = {"Fiber": ("Fiber_Cut", "Fiber_Crack", "Fiber_Aging"), "XCON": ("XCON_Port_Down", "XCON_Buffer_Overflow", "XCON_Fabric_Fault"), "Line": ("Line_Disconnect",)}
#: Forms of a call and of its arguments.
ACTION = r"(?m)ACTION:\s*(\w+)\((.*)\)\s*$"
ARGUMENT = r"""(\w+)\s*=\s*(?:"([^"]*?)"|'([^']*?)'|\(([^)]*?)\)|(\[[^\]]*?\])|([\w.\-$/]+))"""
#: Features written in a prompt, and what each looks like.
FEATURES = {"bbe_max": r"[\d.]+", "pattern_kind": r"\w+", "peak_board": r"[\w\-$]+", "peak_node": r"\w+", "burst_regions": r"\d+", "longest_burst_frac": r"[\d.]+", "bber_bbe_ratio": r"[\d.]+", "es_frac": r"[\d.]+"}
NUMBERS = {"bbe_max": "double", "burst_regions": "int", "longest_burst_frac": "double", "bber_bbe_ratio": "double", "es_frac": "double"}
#: Methods and datasets that experiment names are made of.
EXPERIMENT_METHODS = ("zero-shot", "sft", "grpo", "agent")
EXPERIMENT_DATASETS = ("dataset_a", "dataset_b", "dataset_c", "dataset_d", "dataset_e")
PATHS_HEADER = "topology/lightpaths"


def action_arguments(texts: DataFrame, id_col: str) -> DataFrame:
    """Arguments of all calls in ``text``: (id, step, tool, key, value, type); numbers, lists and tuples are told by their type."""
    calls = F.arrays_zip(F.regexp_extract_all("text", F.lit(ACTION), F.lit(1)).alias("tool"), F.regexp_extract_all("text", F.lit(ACTION), F.lit(2)).alias("args"))
    df = texts.select(id_col, F.posexplode(calls).alias("step", "c")).select(id_col, "step", "c.tool", "c.args")
    names = ("key", "double", "single", "tuple", "list", "bare")
    parts = F.arrays_zip(*[F.regexp_extract_all("args", F.lit(ARGUMENT), F.lit(i + 1)).alias(n) for i, n in enumerate(names)], F.regexp_extract_all("args", F.lit(ARGUMENT), F.lit(0)).alias("whole"))
    df = df.select(id_col, "step", "tool", F.explode(parts).alias("p")).select(id_col, "step", "tool", "p.*")
    value = F.regexp_replace(F.regexp_extract("whole", r"(?s)=\s*(.*)$", 1), r"""^["'(]|["')]$""", "")
    number = F.when(F.col("bare").rlike(r"^-?\d+$"), "int").when(F.col("bare").try_cast("double").isNotNull(), "float").otherwise("text")
    kind = F.when(F.col("bare") != "", number).when(F.col("list") != "", "list").when(F.col("whole").rlike(r"=\s*\("), "tuple").otherwise("text")
    return df.select(id_col, "step", "tool", "key", value.alias("value"), kind.alias("type"))


def tool_usage(records: DataFrame, id_col: str) -> DataFrame:
    """Steps, calls (given, else those found in the text), the tools used and their sequence; records: id, text, steps, calls."""
    tools = F.regexp_extract_all("text", F.lit(ACTION), F.lit(1))
    return records.withColumn("_t", tools).select(
        id_col, F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("calls", F.size("_t")).alias("calls"), F.array_join(F.array_sort(F.array_distinct("_t")), ",").alias("tools"), F.array_join("_t", ">").alias("sequence")
    )


def usage_stats(usage: DataFrame) -> DataFrame:
    """Mean steps and calls over all, correct and wrong examples; usage: steps, calls, correct."""
    one = lambda name, cond: usage.filter(cond).agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.avg("steps").alias("avg_steps"), F.avg("calls").alias("avg_calls"))
    return one("all", F.lit(True)).unionByName(one("correct", F.col("correct") == 1)).unionByName(one("wrong", F.col("correct") == 0))


def tool_heatmap(usage: DataFrame, scenario: str, tools: list[str]) -> DataFrame:
    """Mean calls an example by scenario and tool; ``tools`` is a fixed list."""
    calls = lambda tool: F.size(F.filter(F.split("sequence", ">"), lambda x: x == tool))
    return usage.groupBy(scenario).agg(*[F.avg(calls(t)).alias(t) for t in tools])


def features_of_prompt(text: Column) -> dict[str, Column]:
    """The features written on the pattern line, typed; null where they are missing."""
    out = {}
    for name, form in FEATURES.items():
        found = F.nullif(F.regexp_extract(text, rf"pattern_features:.*?{name}=({form})", 1), F.lit(""))
        out[name] = found.try_cast(NUMBERS[name]) if name in NUMBERS else found
    return out


def prompt_paths(text: Column) -> Column:
    """Lines of boards after the topology header: the first run of lines that begin with ROADM."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    header = F.array_position(F.transform(lines, lambda x: x.startswith(PATHS_HEADER)), True)
    rest = F.when(header > 0, F.slice(lines, (header + 1).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    first = F.array_position(F.transform(rest, lambda x: x.startswith("ROADM")), True)
    run = F.when(first > 0, F.slice(rest, first.cast("int"), F.size(rest))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(run, lambda x: x.startswith("ROADM")), False)
    return F.when(stop > 0, F.slice(run, F.lit(1), (stop - 1).cast("int"))).otherwise(run)


def experiment_parts(name: Column) -> dict[str, Column]:
    """``method_dataset_subdir`` of an experiment's name; an unknown method leaves the whole name as dataset."""
    method = F.coalesce(*[F.when(name.startswith(m + "_"), m) for m in EXPERIMENT_METHODS])
    rest = F.substring(name, F.length(method) + 2, F.length(name))
    dataset = F.coalesce(*[F.when((rest == d) | rest.startswith(d + "_"), d) for d in EXPERIMENT_DATASETS])
    sub = F.when(F.length(rest) > F.length(dataset), F.substring(rest, F.length(dataset) + 2, F.length(rest)))
    return {"method": F.coalesce(method, F.lit("unknown")), "dataset": F.when(method.isNull(), name).otherwise(F.coalesce(dataset, rest)), "subdir": sub}


def event_for_board(kind: Column, key: Column, seed: int) -> Column:
    """An event drawn from the pool of the board's category; null for unknown kinds."""
    category = S.board_category(kind)
    pick = lambda pool: F.element_at(F.array(*[F.lit(e) for e in pool]), (F.pmod(draw(key, seed), F.lit(len(pool))) + 1).cast("int"))
    return F.coalesce(*[F.when(category == c, pick(pool)) for c, pool in EVENT_POOLS.items()])


def staggered_picks(failed: DataFrame, n: int, gap_s: int, seed: int) -> DataFrame:
    """One failed board on each of ``n`` nodes, ``gap_s`` apart: board, node, place, offset_s."""
    w = W.partitionBy("node").orderBy(draw(F.col("board"), seed), "board")
    one = failed.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k").orderBy(draw(F.col("board"), seed), "board").limit(n)
    place = F.row_number().over(W.orderBy(draw(F.col("board"), seed), "board"))  # n rows
    return one.select("board", "node", place.alias("place")).withColumn("offset_s", (F.col("place") - 1) * gap_s)


def multi_failure_truth(failures: DataFrame, run: str) -> DataFrame:
    """All root boards and events of a run in order of time, and their number."""
    g = failures.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("time", "board", "event"))).alias("x"), F.count(F.lit(1)).alias("n_failures"))
    text = lambda c: F.array_join(F.transform("x", lambda t: t[c].cast("string")), ",")
    return g.select(run, text("board").alias("root_boards"), text("event").alias("root_events"), "n_failures")


def dimension_metadata(examples: DataFrame, labels: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Sweep keys that the labels have, copied to the examples under their names; others are left out."""
    have = {old: new for old, new in names.items() if old in labels.columns}
    return examples.join(labels.select(key, *[F.col(o).alias(n) for o, n in have.items()]), key, "left")


def mask_observation(texts: DataFrame, id_col: str, frac: float, seed: int) -> DataFrame:
    """A fraction of the board lines of ``text`` replaced, that of ``peak`` always; features blanked; a warning appended.

    Board lines are those that begin with two blanks and a board; max(1, floor(n * frac)) of them go, the peak's first,
    then by hash of their place. All within the row.
    """
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.rlike(r"^  ROADM").alias("b")))
    order = F.array_sort(F.transform(F.filter("_l", lambda s: s["b"]), lambda s: F.struct((~s["x"].contains(F.col("peak"))).alias("a"), F.pmod(s["i"].cast("long") * 2654435761 + seed, F.lit(1000003)).alias("h"), s["i"].alias("i"))))
    n = F.greatest(F.lit(1), F.floor(F.size("_o") * frac).cast("int"))
    df = texts.withColumn("_l", lines).withColumn("_o", order).withColumn("_gone", F.transform(F.slice("_o", F.lit(1), n), lambda s: s["i"]))
    kept = F.transform("_l", lambda s: F.when(F.array_contains("_gone", s["i"]), "  [masked]").otherwise(F.regexp_replace(s["x"], r"^(pattern_features:).*$", "$1 (masked)")))
    return df.select(id_col, F.concat(F.array_join(kept, "\n"), F.lit("\nWarning: "), F.size("_gone").cast("string"), F.lit(" boards masked")).alias("text"))


def sft_examples(truth: DataFrame) -> DataFrame:
    """Prompt and worked answer as messages; truth: id, topology, features, rules, board, event, time, severity, reasoning, rows, fixes."""
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.coalesce(F.col(p[1:]).cast("string"), F.lit("")) for p in parts])
    user = c("Observations:\n", "$topology", "\n\n", "$features", "\n\nRules:\n", "$rules", "\n\nTask: name board, event and time of the root cause, predict the alarm flow, and explain.")
    answer = c("Metric-based diagnosis:\n", "$reasoning", "\n\nRoot cause (predicted):\n- Board: ", "$board", "\n- Event: ", "$event", "\n- Time: ", "$time", "\n- Severity: ", "$severity", "\n\nPredicted alarm_flow rows (CSV):\n", "$rows", "\n\nRCA reasoning:\n- Rules used:\n", "$rules", "\nFix ideas:\n", "$fixes")
    return truth.select("id", user.alias("user"), answer.alias("assistant"))


#: What a temporal pattern tells of a board of each category, and the event it points to.
CAUSES = {
    ("Fiber", "ramp"): ("a slow decline", "Fiber_Aging"),
    ("Fiber", "step"): ("a sudden and lasting loss", "Fiber_Cut"),
    ("Fiber", "step_recovery"): ("a loss with recoveries", "Fiber_Crack"),
    ("XCON", "step"): ("a sudden and lasting rise", "XCON_Port_Down"),
    ("XCON", "burst"): ("spikes in bursts", "XCON_Buffer_Overflow"),
    ("XCON", "step_recovery"): ("a rise with recoveries", "XCON_Fabric_Fault"),
}


def reasoning_steps(summary: Column, event: Column) -> Column:
    """Lines that lead from a summary's features to ``event``: the peak board's kind and category; what its pattern tells in that category;
    further features that the summary gives; the conclusion. Without a peak board two lines say that other evidence decides."""
    # Each value is computed once and given a name: written out in place, the expression would grow with the product of its parts.
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    features = features_of_prompt(summary)

    def lines(f: Column, kind: Column, category: Column) -> Column:
        shown = F.concat(F.lit("pattern_kind="), F.coalesce(f["pattern_kind"], F.lit("unknown")), F.coalesce(F.concat(F.lit(", burst_regions="), f["burst_regions"].cast("string")), F.lit("")))
        told = F.when(category == "Line", "a line card that lost its signal: Line_Disconnect")
        for (c, p), (what, cause) in CAUSES.items():
            told = told.when((category == c) & (f["pattern_kind"] == p), f"{what}: {cause}")
        told = told.otherwise(F.concat(F.lit("no usual pattern of "), category, F.lit(", further features decide")))
        first = F.concat(F.lit("Step 1: the peak board "), f["peak_board"], F.when(category == "unknown", " is of no known kind, so the series decides.").otherwise(F.concat(F.lit(" is a "), kind, F.lit(" board, category "), category, F.lit("."))))
        second = F.when(category != "unknown", F.concat(F.lit("Step 2: "), shown, F.lit(" shows "), told, F.lit(".")))
        given = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), S.fixed(f[n], d)) for n, d in (("bber_bbe_ratio", 2), ("es_frac", 4), ("bbe_max", 1))])
        third = let(given, lambda g: F.when(g != "", F.concat(F.lit("Step 3: "), g, F.lit(" agree with "), event, F.lit("."))))
        last = F.concat(F.lit("Conclusion: "), event, F.lit(" on board "), f["peak_board"], F.lit("."))
        none = F.array(F.lit("Step 1: no pattern features, so other evidence decides."), F.concat(F.lit("Conclusion: the alarms point to "), event, F.lit(".")))
        return F.when(f["peak_board"].isNull(), none).otherwise(F.array_compact(F.array(first, second, third, last)))

    category = lambda kind: F.when(kind == "UNKNOWN", "unknown").otherwise(S.board_category(kind))
    with_kind = lambda f: let(S.parse_board(f["peak_board"])["kind"], lambda kind: let(category(kind), lambda c: lines(f, kind, c)))
    return let(F.struct(*[c.alias(n) for n, c in features.items()]), with_kind)


def triage(prompt: Column) -> tuple[Column, Column]:
    """The peak board a prompt names, and its category, which is the route it takes."""
    board = F.nullif(F.regexp_extract(prompt, r"peak_board=([\w\-$]+)", 1), F.lit(""))
    return board, F.coalesce(S.board_category(S.parse_board(board)["kind"]), F.lit("unknown"))


def hits_block(hits: DataFrame, by: str, top: int, preview: int = 280) -> DataFrame:
    """The ``top`` ranked hits (rank, score, path, chunk, text) of each query as one text with scores and places.

    The cut comes before texts are gathered, so a query's text has a bounded number of lines.
    """
    flat = F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))
    body = F.when(F.length(flat) > preview, F.concat(F.left(flat, F.lit(preview)), F.lit("..."))).otherwise(flat)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] score="), S.fixed(F.col("score"), 4), F.lit(" path="), F.col("path").cast("string"), F.lit(" chunk="), F.col("chunk").cast("string"), F.lit("\n  "), body)
    g = hits.filter(F.col("rank") <= top).select(by, "rank", line.alias("line")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return g.select(by, F.array_join(F.transform("x", lambda t: t["line"]), "\n").alias("block"))
