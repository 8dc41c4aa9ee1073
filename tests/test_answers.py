"""Answers parsed and rewarded against plain loops."""

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from lumentrace.operators import texts as X
from lumentrace.plans import answer_queries, registry

SF = "/root/testdata/sf0.001"


def block_of(text):
    for mark in X.START_MARKS:
        if mark in text:
            rest = text[text.index(mark) + len(mark) :]
            ends = [rest.find(e) for e in X.END_MARKS]
            return rest[: min([e for e in ends if e > 0], default=len(rest))].strip()
    return "\n".join(line for line in text.split("\n") if line.count(",") >= 19)


def table_of(text):
    lines = [x.strip() for x in block_of(text).split("\n") if x.strip()]
    if not lines:
        return []
    head = [h.strip() for h in lines[0].split(",")]
    rows = [x.split(",") for x in lines[1:]]
    return [dict(zip(head, map(str.strip, r), strict=False)) for r in rows if len(r) >= min(len(head), 6)]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def smooth(a):
    text, rows = a["text"], table_of(a["text"])
    want = a["gt_event"].upper().replace("_", " ")
    named = [m.replace("_", " ").strip() for m in re.findall(X.EVENT_MENTION, text.upper())]
    event = max((ratio(want, m) for m in named), default=0.3 if a["gt_event"].split("_")[0].upper() in text.upper() else 0.0)
    board = max((ratio(a["gt_board"].upper(), m.upper()) for m in re.findall(r"ROADM\d+[A-Za-z0-9_$\-]*", text, re.I)), default=0.0)
    found, true = {r["PropToBoard"] for r in rows if r.get("PropToBoard", "").startswith("ROADM")}, set(a["gt_boards"])
    area = len(found & true) / len(found | true) if found and true else float(not found and not true)
    said, alarms = [r["PropAlarm"] for r in rows if r.get("PropAlarm")], a["gt_alarms"]
    kinds = {*said, *alarms}
    share = sum(min(said.count(k), alarms.count(k)) for k in kinds) / sum(max(said.count(k), alarms.count(k)) for k in kinds) if kinds else 0.0
    return 0.25 * event + 0.15 * board + 0.25 * area + 0.15 * share


def test_continuous_reward_equals_plain_loops(spark):
    answers = answer_queries.answers(spark, SF).collect()
    got = {r["sample_index"]: r["reward"] for r in registry.queries()["reward_continuous"](spark, SF).collect()}
    assert len(got) == len(answers)
    for a in answers:
        assert abs(got[a["sample_index"]] - smooth(a)) < 1e-6, a["sample_index"]


def test_continuous_reward_covers_the_form(spark):
    """The reward of the form was left to another query; header, full rows and their number against plain loops."""
    answers = answer_queries.answers(spark, SF).collect()
    got = {r["sample_index"]: r["format_reward"] for r in registry.queries()["reward_continuous"](spark, SF).collect()}
    for a in answers:
        lines = [x for x in block_of(a["text"]).split("\n") if x.strip()]
        want = 0.0
        if lines:
            data = lines[1:] if lines[0].count(",") >= 19 else lines
            want = 0.05 * sum(h.upper() in lines[0].upper() for h in X.HEADER) / len(X.HEADER)
            if data:
                want += 0.10 * sum(x.count(",") >= 19 for x in data) / len(data) + 0.05 * min(len(data), a["gt_rows"]) / max(len(data), a["gt_rows"])
        assert abs(got[a["sample_index"]] - want) < 1e-6, a["sample_index"]
    assert len(set(got.values())) > 3


def test_blocks_of_awkward_texts(spark):
    wide = "," * 19
    texts = [None, "", "no table", "alarm_flow rows:\n\nRCA reasoning: x", "SourceBoard,SourceAlarm,a\nb,c", f"x\n{wide}\ny", "alarm_flow CSV:\n a,b \nFix 1\nc", "Predicted alarm_flow\na\n\n\nb", "alarm_flow rows:\nRCA reasoning: x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r["block"] for r in df.select("i", X.csv_block(F.col("text")).alias("block")).orderBy("i").collect()]
    assert got == [None if t is None else block_of(t) for t in texts]


def test_topk_by_blocks_equals_all_pairs(spark):
    """Many copies, odd vectors and more than one block of vectors and of queries, against plain loops."""
    import math
    import random

    from lumentrace.operators import rootcause as R

    rng = random.Random(6)
    rows = [(i, [rng.choice((-1.0, 0.5, 2.0)) for _ in range(5)]) for i in range(150)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(150, 220)]
    rows += [(220, None), (221, [1.0, 2.0]), (222, [1.0, None, 1.0, 1.0, 1.0]), (223, [1e-9, 0.0, 0.0, 0.0, 0.0])]
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows if v and len(v) == 5 and None not in v}
    want = {}
    for a in (x for x in unit if x % 3 == 0):
        found = sorted((-round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 9), b) for b in unit if b != a)[:7]
        want[a] = [(b, -s) for s, b in found]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before, R.BLOCK = R.BLOCK, 40
    try:
        got = R.topk_inner_product(df, df.filter("vec_id % 3 = 0"), 7).collect()
    finally:
        R.BLOCK = before
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {a: out[a] for a in want} == want
    # A null question scores null with all, as its SQL says.
    assert [s for _, s in out[222]] == [None] * 7
    few = R.block_best(*[pd.DataFrame({c: range(300), v: [[0.6, 0.8]] * 300}) for c, v in (("query_id", "qv"), ("vec_id", "v"))], 4)
    assert len(few) == 1200


def test_reasoning_steps_name_each_value_once(spark):
    """The expression holds each pattern a few times only: it took longer than a minute to plan when values were written out in place."""
    from lumentrace.operators import studies as U

    column = U.reasoning_steps(F.col("text"), F.lit("E1"))
    assert str(column).count("peak_board=") <= 3
    text = "pattern_features: bbe_max=3.25 pattern_kind=step peak_board=ROADM1-XCON001$0"
    got = spark.createDataFrame([(text,), ("nothing",)], "text string").select(column).collect()
    assert got[0][0] == ["Step 1: the peak board ROADM1-XCON001$0 is a XCON board, category XCON.", "Step 2: pattern_kind=step shows a sudden and lasting rise: XCON_Port_Down.", "Step 3: bbe_max=3.2 agree with E1.", "Conclusion: E1 on board ROADM1-XCON001$0."]
    assert got[1][0] == ["Step 1: no pattern features, so other evidence decides.", "Conclusion: the alarms point to E1."]


def test_tables_are_read_once_for_all_their_columns(spark):
    """Lines and values were written out in place wherever they were used, inside loops over rows and kinds too."""
    x = F.col("lines_")
    for column in (X.csv_column(x, "Hop"), X.table_boards(x), X.table_reward(x, F.col("b"), F.col("a")), X.overlap(x, F.col("a"))):
        assert str(column).count("lines_") == 1
    assert str(X.event_reward(F.col("text_"), F.col("e"))).count("text_") == 1
    plan = X.per_example(answer_queries.answers(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PropToBoard), ") <= 2


def test_overlap_and_likeness_equal_plain_loops(spark):
    """Few and many kinds, nothing on a side, words alike in all letters, the truth among the words; and one text of many rows in one go."""
    from collections import Counter

    rows = [([], []), (["a"], []), ([], ["a"]), (["a", "a", "b"], ["a", "b", "b", "c"]), ([str(i % 90) for i in range(400)], [str(i % 70) for i in range(300)])]
    for (p, t), r in zip(rows, spark.createDataFrame(rows, "p array<string>, t array<string>").select(X.overlap(F.col("p"), F.col("t"))).collect(), strict=True):
        a, b = Counter(p), Counter(t)
        assert r[0] == ((a & b).total() / (a | b).total() if p or t else 1.0)
    words = ["FIBER CUT", "FIBER TUC", "CUT FIBER", "XCON DOWN", "FIBER CRACK", "", "Z"]
    pairs = [(w, [v for v in words if v != w][::s]) for w in words for s in (1, -1)] + [("FIBER CUT", words), ("X", []), ("X", None)]
    got = spark.createDataFrame(pairs, "t string, m array<string>").coalesce(1).select(X.best_similarity("t", "m")).collect()
    assert [r[0] for r in got] == [max((ratio(t, m) for m in ms or ()), default=0.0) for t, ms in pairs]
    n = 3000
    text = "alarm_flow rows:\nSourceBoard,e,t,r,PropToBoard,PropAlarm,Severity\n" + "\n".join(f"ROADM1-A{i},e,t,r,ROADM2-B{i}, K{i % 50} ,S" for i in range(n))
    lines = X.csv_lines(X.csv_block(F.col("text")))
    r = spark.createDataFrame([(text,)], "text string").select(F.size(X.table_boards(lines)), X.table_values(lines, "PropAlarm").alias("k")).first()
    assert (r[0], Counter(r["k"])) == (2 * n, Counter({f"K{i}": n // 50 for i in range(50)}))
