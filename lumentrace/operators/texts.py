"""Texts: parsing what models and logs say, and rendering observations into prompts."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lumentrace.functions import scalars as S

from . import evaluation as E

#: Marks that open a table in an answer, tried in this order, and those that close it.
START_MARKS = ("alarm_flow rows (CSV):", "alarm_flow rows:", "alarm_flow CSV:", "Predicted alarm_flow", "SourceBoard,SourceAlarm")
END_MARKS = ("\nRCA reasoning:", "\nFix ideas:", "\nFix ", "\n\n\n", "\n---")
#: Columns looked for in a header line, and the commas of a full row.
HEADER = ("SourceBoard", "SourceAlarm", "PropToBoard", "PropAlarm", "Hop", "Severity", "Service", "Direction", "Layer")
FULL_ROW = 19


def commas(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once, however often and inside whatever loops the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def csv_block(text: Column) -> Column:
    """After the first start mark that occurs up to the nearest end mark; without a mark, the lines of full rows.

    Where the mark is the header's own beginning, the block starts after it, so that the header is cut.
    """

    def cut(rest: Column) -> Column:
        # An end mark right at the start closes nothing.
        ends = F.array_min(F.filter(F.array(*[F.instr(rest, e) for e in END_MARKS]), lambda i: i > 1))
        return stripped(F.substring(rest, F.lit(1), F.coalesce(ends, F.length(rest) + 1) - 1))

    def after(mark: str) -> Column:
        return F.when(F.contains(text, F.lit(mark)), bound(F.substring(text, F.instr(text, mark) + len(mark), F.length(text)), cut))

    loose = F.array_join(F.filter(F.split(text, "\n"), lambda x: commas(x) >= FULL_ROW), "\n")
    return F.coalesce(*[after(m) for m in START_MARKS], loose)


def csv_lines(block: Column) -> Column:
    return F.filter(F.transform(F.split(block, "\n"), stripped), lambda x: x != "")


def csv_header(lines: Column) -> Column:
    return F.transform(F.split(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), ",", -1), stripped)


def csv_fields(lines: Column) -> Column:
    """Fields of the rows below the header that have min(header, 6) fields at least."""
    return csv_table(lines)["rows"]


def csv_table(lines: Column) -> Column:
    """``header``, and ``rows`` of fields: a struct that reads a table's lines once for all the columns taken from it."""

    def table(of: Column, header: Column) -> Column:
        split = F.transform(F.slice(of, F.lit(2), F.greatest(F.size(of) - 1, F.lit(0))), lambda x: F.split(x, ",", -1))
        rows = bound(F.least(F.size(header), F.lit(6)), lambda least: F.filter(split, lambda f: F.size(f) >= least))
        return F.struct(header.alias("header"), rows.alias("rows"))

    return bound(lines, lambda of: bound(csv_header(of), lambda header: table(of, header)))


def column_of(table: Column, name: str) -> Column:
    """A column's value in every row, as ``csv_column`` gives it, of what ``csv_table`` has read."""
    value = lambda at: F.transform(table["rows"], lambda f: F.coalesce(F.when(at > 0, stripped(F.get(f, (at - 1).cast("int")))), F.lit("")))
    return bound(F.array_position(table["header"], name), value)


def csv_column(lines: Column, name: str) -> Column:
    """A column's value in every row, empty where the row or the header lacks it; a repeated name counts at its first place."""
    return bound(csv_table(lines), lambda t: column_of(t, name))


def csv_rows(df: DataFrame, id_col: str, block: str) -> DataFrame:
    """Rows of a block as (id, n, column, value) by its header; rows of fewer than min(header, 6) fields are dropped."""
    lines = csv_lines(F.col(block))
    x = df.select(id_col, csv_header(lines).alias("h"), F.posexplode(csv_fields(lines)).alias("n", "v"))
    pair = F.explode(F.arrays_zip(F.col("h").alias("column"), F.col("v").alias("value")))
    return x.select(id_col, "n", pair.alias("p")).select(id_col, "n", F.col("p.column").alias("column"), stripped(F.col("p.value")).alias("value")).filter("column is not null and value is not null")


def table_boards(lines: Column, sources: bool = True) -> Column:
    """Distinct boards that alarms reach, and with ``sources`` those they come from."""
    return bound(csv_table(lines), lambda t: boards_of(t, sources))


def boards_of(table: Column, sources: bool = True) -> Column:
    names = column_of(table, "PropToBoard")
    if sources:
        names = F.concat(names, column_of(table, "SourceBoard"))
    return F.array_distinct(F.filter(names, lambda b: b.startswith("ROADM")))


def table_values(lines: Column, name: str) -> Column:
    return bound(csv_table(lines), lambda t: values_of(t, name))


def values_of(table: Column, name: str) -> Column:
    return F.filter(column_of(table, name), lambda v: v != "")


def overlap(pred: Column, truth: Column) -> Column:
    """Sum of the smaller counts over sum of the larger of two arrays' values; 1 if both are empty."""
    times = lambda of, k: F.size(F.filter(of, lambda v: v == k))

    def share(x: Column) -> Column:
        both = F.aggregate(F.array_union(x["p"], x["t"]), F.lit(0), lambda acc, k: acc + F.least(times(x["p"], k), times(x["t"], k)))
        # The smaller and the larger counts of all values add up to both sizes.
        all_ = F.size(x["p"]) + F.size(x["t"])
        return F.when(all_ == 0, 1.0).otherwise(bound(both, lambda n: n / (all_ - n)))

    return bound(F.struct(pred.alias("p"), truth.alias("t")), share)


def all_events(text: Column) -> Column:
    """Distinct events of all ``Event: X`` mentions in order, else the one found anywhere."""
    named = F.transform(F.regexp_extract_all(text, F.lit(r"Event:\s*([A-Za-z_]+)"), F.lit(1)), lambda x: S.normalize_event(x))
    known = F.array_distinct(F.filter(named, lambda x: x.isNotNull()))
    return bound(known, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array_compact(F.array(S.event_in_text(text)))))


def header_coverage(line: Column) -> Column:
    """Share of the expected column names that a line holds, in any case."""
    return sum((F.when(F.upper(line).contains(h.upper()), 1.0).otherwise(0.0) for h in HEADER), F.lit(0.0)) / len(HEADER)


def truncate_rows(text: Column, rows: int) -> Column:
    lines = F.split(text, "\n")
    more = F.size(lines) - rows
    return F.when(more > 0, F.concat(F.array_join(F.slice(lines, 1, rows), "\n"), F.lit("\n(truncated "), more.cast("string"), F.lit(" rows)"))).otherwise(text)


def path_lines(text: Column, header: str) -> Column:
    """Board lists in the lines that follow a header without a gap."""
    rest = F.split(F.regexp_extract(text, header + r"[^\n]*\n((?:ROADM[^\n]*(?:\n|$))*)", 1), "\n")
    return F.filter(rest, lambda x: x != "")


def _rows_of(lines: Column, has_header: Column) -> tuple[Column, Column]:
    """Number of data lines, and of those with a full row's commas."""
    data = F.when(has_header, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.size(data), F.size(F.filter(data, lambda x: commas(x) >= FULL_ROW))


def _parts(lines: Column, truth_rows: Column, has_header: Column) -> tuple[Column, Column]:
    n, good = _rows_of(lines, has_header)
    near = F.when((truth_rows > 0) & (n > 0), F.least(n, truth_rows) / F.greatest(n, truth_rows)).otherwise(0.0)
    return F.when(n > 0, good / n).otherwise(0.0), near


def format_score(lines: Column, truth_rows: Column) -> Column:
    """A quarter for a full header, a half for full rows, a quarter for a row count near the truth."""
    head = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    has = (commas(head) >= FULL_ROW) & head.contains("SourceBoard")
    good, near = _parts(lines, truth_rows, has)
    return F.when(F.size(lines) <= 0, 0.0).otherwise(F.when(has, 0.25).otherwise(0.0) + 0.5 * good + 0.25 * near)


def format_reward(lines: Column, truth_rows: Column, smooth: bool = False) -> Column:
    """Header .05 (with ``smooth`` its covered share), full rows .10, row count .05."""
    head = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    wide = commas(head) >= FULL_ROW
    good, near = _parts(lines, truth_rows, wide)
    first = header_coverage(head) if smooth else F.when(wide & head.contains("SourceBoard"), 1.0).otherwise(0.0)
    return F.when(F.size(lines) <= 0, 0.0).otherwise(0.05 * first + 0.10 * good + 0.05 * near)


#: How events are written in answers, strictly and loosely.
EVENT_NAMES = r"(FIBER[_ ]?CUT|FIBER[_ ]?CRACK|FIBER[_ ]?AGING|LINE[_ ]?DISCONNECT|XCON[_ ]?PORT[_ ]?DOWN|XCON[_ ]?FABRIC[_ ]?FAULT|XCON[_ ]?BUFFER[_ ]?OVERFLOW)"
EVENT_MENTION = (
    r"(FIBER[_\s]?(?:CUT|CRACK|AGING|BREAK|DAMAGE|DEGRAD\w*|FAIL\w*)|LINE[_\s]?(?:DISCONNECT|FAULT|FAIL\w*|DOWN)|"
    r"XCON[_\s]?(?:PORT[_\s]?DOWN|FABRIC[_\s]?FAULT|BUFFER[_\s]?OVERFLOW|FAIL\w*|FAULT|DOWN)|REGEN[_\s]?(?:FAIL\w*|FAULT|DOWN))"
)
BOARD_MENTION = r"(?i)(ROADM\d+[A-Za-z0-9_$\-]*)"


def table_reward(lines: Column, boards: Column, alarms: Column) -> Column:
    """Boards' Jaccard .25 and alarms' overlap .15 of a table against true boards (distinct) and alarms (with repeats)."""

    def reward(x: Column) -> Column:
        found, named = x["found"], x["named"]
        both = F.size(F.array_intersect(found, boards)) / F.size(F.array_union(found, boards))
        area = F.when((F.size(boards) > 0) & (F.size(found) > 0), both).when((F.size(boards) == 0) & (F.size(found) == 0), 1.0).otherwise(0.0)
        return 0.25 * area + F.when((F.size(named) > 0) | (F.size(alarms) > 0), 0.15 * overlap(named, alarms)).otherwise(0.0)

    read = lambda t: F.struct(boards_of(t, sources=False).alias("found"), values_of(t, "PropAlarm").alias("named"))
    return bound(bound(csv_table(lines), read), reward)


def event_reward(text: Column, event: Column) -> Column:
    """.25 if the event is named; else .10 if the first event named has its category, .03 if only the category is named."""
    spaced, category = F.replace(F.upper(event), F.lit("_"), F.lit(" ")), F.split(F.upper(event), "_")[0]

    def reward(up: Column) -> Column:
        named = lambda first: F.when(first != "", F.when(F.regexp_extract(first, "^([^_ ]*)", 1) == category, 0.10).otherwise(0.0)).when(up.contains(category), 0.03).otherwise(0.0)
        return F.when(up.contains(spaced) | up.contains(F.upper(event)), 0.25).otherwise(bound(F.regexp_extract(up, EVENT_NAMES, 1), named))

    return bound(F.upper(text), reward)


def board_reward(text: Column, board: Column) -> Column:
    """.15 if the board is named, .05 if its node is."""
    node = F.regexp_extract(board, "^([^-]*)-", 1)
    return F.when(board == "", 0.0).when(text.contains(board), 0.15).when((node != "") & text.contains(node), 0.05).otherwise(0.0)


#: Pairs of words whose likeness a batch of answers keeps.
KNOWN = 10_000


@F.pandas_udf(DoubleType())
def best_similarity(truth: pd.Series, mentions: pd.Series) -> pd.Series:
    """Largest matching-block ratio of the truth with any of the mentions; 0 without mentions."""
    best, known = [], {}
    for t, found in zip(truth, mentions, strict=True):
        most, at = 0.0, {}
        for m in dict.fromkeys(found if found is not None else ()):
            if m == t:
                most = 1.0
                break
            at[m] = known.get((t, m))
        # Nothing is liker than the truth itself, and letters alone bound what a pair can reach.
        if most < 1.0:
            for m, r in at.items():
                if r is None:
                    like = SequenceMatcher(None, t, m)
                    if like.real_quick_ratio() <= most or like.quick_ratio() <= most:
                        continue
                    r = like.ratio()
                    if len(known) < KNOWN:
                        known[t, m] = r
                most = max(most, r)
        best.append(most)
    return pd.Series(best, dtype="float64")


def event_similarity(text: Column, event: Column) -> Column:
    """Likeness of the event to the best event named; .3 if only its category is named."""
    found = F.transform(F.regexp_extract_all(F.upper(text), F.lit(EVENT_MENTION), F.lit(1)), lambda m: F.trim(F.replace(m, F.lit("_"), F.lit(" "))))
    category = F.split(F.upper(event), "_")[0]
    weak = F.when((category != "") & F.upper(text).contains(category), 0.30).otherwise(0.0)
    return F.when(event == "", 0.0).when(F.size(found) == 0, weak).otherwise(best_similarity(F.trim(F.replace(F.upper(event), F.lit("_"), F.lit(" "))), found))


def board_similarity(text: Column, board: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(BOARD_MENTION), F.lit(1)), F.upper))
    return F.when(board == "", 0.0).otherwise(best_similarity(F.upper(board), found))


def per_example(answers: DataFrame) -> DataFrame:
    """The score row of every answer.

    ``answers``: sample_index, text, gt_event, gt_board, gt_boards (distinct), gt_alarms and gt_severities (with repeats),
    gt_rows, n_failures, gt_root_events (distinct; may be empty). All within the row, so nothing is shuffled.
    """
    df = answers.withColumns({"_l": csv_lines(csv_block(F.col("text"))), "_e": S.event_in_text(F.col("text")), "_b": S.board_in_text(F.col("text")), "_all": all_events(F.col("text"))})
    read = lambda t: F.struct(boards_of(t).alias("boards"), values_of(t, "PropAlarm").alias("alarms"), values_of(t, "Severity").alias("sev"))
    df = df.withColumn("_t", bound(csv_table(F.col("_l")), read)).withColumns({"_boards": F.col("_t.boards"), "_alarms": F.col("_t.alarms"), "_sev": F.col("_t.sev")})
    prf = E.set_prf(F.col("_boards"), F.col("gt_boards"))
    alarm, severity, form = overlap(F.col("_alarms"), F.col("gt_alarms")), overlap(F.col("_sev"), F.col("gt_severities")), format_score(F.col("_l"), F.col("gt_rows"))
    known = lambda e: F.when(e.isin(*S.EVENTS), S.event_category(e)).otherwise("")
    category, gt_category = known(F.coalesce("_e", F.lit(""))), known(F.col("gt_event"))
    event, board = E.matches(F.col("_e"), F.col("gt_event")), E.matches(F.col("_b"), F.col("gt_board"))
    roots = E.root_metrics(F.col("_all"), F.col("gt_root_events"))
    multi = (F.col("n_failures") > 1) & (F.size("gt_root_events") > 0)
    r = lambda c: F.round(c, 4)
    return df.select(
        "sample_index", "gt_event", "gt_board", gt_category.alias("gt_category"), F.coalesce("_e", F.lit("")).alias("pred_event"), F.coalesce("_b", F.lit("")).alias("pred_board"), category.alias("pred_category"),
        event.alias("event_correct"), board.alias("board_correct"), F.when((category != "") & (category == gt_category), 1).otherwise(0).alias("category_correct"),
        r(prf["f1"]).alias("board_f1"), r(prf["precision"]).alias("board_precision"), r(prf["recall"]).alias("board_recall"), r(alarm).alias("alarm_f1"), r(severity).alias("severity_f1"),
        r(form).alias("format_score"), r(E.composite(event, board, prf["f1"], alarm, form)).alias("e2e_score"),
        F.size("_boards").alias("pred_boards_count"), F.size("gt_boards").alias("gt_boards_count"), F.size(F.array_distinct("_alarms")).alias("pred_alarm_types"), F.size(F.array_distinct("gt_alarms")).alias("gt_alarm_types"),
        "n_failures", *[F.when(multi, r(c)).alias(n) for n, c in roots.items()],
    )


def render_hits(hits: DataFrame, by: str, preview: int = 280) -> DataFrame:
    """Ranked hits (rank, score, text) of each query as one text."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(preview)))
    g = hits.select(by, "rank", line.alias("line")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return g.select(by, F.array_join(F.transform("x", lambda t: t["line"]), "\n").alias("block"))


def reasoning_line(category: Column, pattern: Column) -> Column:
    shape = F.when(pattern == "step", "rises once and stays").when(pattern == "ramp", "rises slowly to a narrow peak").when(pattern == "step_recovery", "stays high between spikes").otherwise("falls back between peaks")
    return F.concat(F.lit("The peak board is a "), category, F.lit(" board whose series "), shape, F.lit("."))


def prompts(features: DataFrame, catalog: DataFrame) -> DataFrame:
    """One observation text per node: its boards, its peak board and that board's features."""
    best = features.groupBy("node").agg(F.min_by(F.struct("board", "bbe_max", "pattern"), F.struct(-F.col("bbe_max"), "board")).alias("b"))
    text = F.concat_ws("\n", F.concat(F.lit("Boards: "), "boards"), F.concat(F.lit("Peak board: "), F.col("b.board").cast("string")), F.concat(F.lit("pattern_kind="), F.col("b.pattern")))
    return catalog.join(best, "node").select("node", text.alias("prompt"))


def mask_lines(df: DataFrame, id_col: str, every: int) -> DataFrame:
    """Every ``every``-th line of a text replaced by a mark, a warning appended."""
    lines = F.split("text", "\n")
    masked = F.transform(lines, lambda x, i: F.when((i + 1) % every == 0, "[masked]").otherwise(x))
    n = F.size(F.filter(masked, lambda x: x == "[masked]"))
    return df.select(id_col, F.concat(F.array_join(masked, "\n"), F.lit("\nWarning: "), n.cast("string"), F.lit(" lines masked")).alias("text"))


def translate_legacy(hops: DataFrame) -> DataFrame:
    """Endpoint tokens become Line1 or Line2 by the side of the next hop, else of the previous one."""
    from pyspark.sql import Window as W

    w = W.partitionBy("path_id").orderBy("pos")
    side = F.coalesce(F.lead("side").over(w), F.lag("side").over(w), F.lit(1))
    return hops.select("path_id", "pos", F.when(F.col("kind") == "LINE", F.concat(F.lit("Line"), side.cast("string"))).otherwise(F.col("kind")).alias("token"))
