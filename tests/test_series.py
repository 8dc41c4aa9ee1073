"""Series operators against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.operators import evaluation as E
from lumentrace.operators import rootcause as R
from lumentrace.operators import series as M


def frame(spark, values):
    return spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(values)], "board long, t int, bbe double")


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        ([0] * 60 + [50] * 40 + [0] * 20, "step"),
        ([*range(100), 100, 0, 0, 0], "ramp"),
        ([0] * 50 + [60, 60, 50, 50, 50, 60, 60] + [0] * 60, "step_recovery"),
        ([0] * 50 + [60, 60, 0, 0, 0, 60, 60] + [0] * 60, "burst"),
    ],
)
def test_pattern_kind(spark, values, kind):
    assert M.pattern_kind(frame(spark, values)).first()["pattern_kind"] == kind


def test_pattern_needs_samples(spark):
    assert M.pattern_kind(frame(spark, [1] * 99)).count() == 0


def test_burst_regions_equal_a_loop(spark):
    rng = random.Random(4)
    values = [rng.choice([0, 3, 20, 40]) for _ in range(200)]
    limit = max(max(values) * 0.5, 5.0)
    runs, n = [], 0
    for v in [*values, 0]:
        if v > limit:
            n += 1
        elif n:
            runs.append(n)
            n = 0
    row = M.burst_regions(frame(spark, values)).first()
    assert (row["burst_regions"], row["longest_burst_frac"]) == (len(runs), max(runs) / sum(runs))


def test_no_burst(spark):
    row = M.burst_regions(frame(spark, [1, 2, 3])).first()
    assert (row["burst_regions"], row["longest_burst_frac"]) == (0, 0.0)


def test_smooth_equals_convolution(spark):
    values = np.random.default_rng(0).random(40)
    got = [r["smooth"] for r in M.smooth(frame(spark, values)).orderBy("t").collect()]
    assert np.allclose(got, np.convolve(values, np.ones(10) / 10, mode="same"))


def test_stagger_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, rng.randrange(100), rng.randrange(1, 30)) for i in range(60)]
    got = {r["id"]: r["start"] for r in M.stagger(spark.createDataFrame(rows, "node int, id int, t0 int, dur int"), 5).collect()}
    end = {}
    for node, i, t0, dur in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start = max(t0, end.get(node, t0))
        assert got[i] == start
        end[node] = start + dur + 5


@pytest.mark.parametrize(("peak", "category", "event"), [(55.0, "Fiber", "Fiber_Cut"), (33.9, "Fiber", "Fiber_Aging"), (100.0, "XCON", "XCON_Fabric_Fault"), (0.0, "Line", "Line_Disconnect"), (-1.0, "unknown", "unknown")])
def test_root_cause_without_pattern(spark, peak, category, event):

    assert spark.range(1).select(R.root_cause(F.lit(category), F.lit("unknown"), F.lit(peak))).first()[0] == event


def test_set_prf_edges(spark):

    df = spark.createDataFrame([([], []), ([1], []), ([1, 2], [2, 3, 4])], "p array<int>, t array<int>")
    m = E.set_prf(F.col("p"), F.col("t"))
    got = [tuple(r) for r in df.select(m["precision"], m["recall"], m["f1"]).collect()]
    assert got[0] == (1, 1, 1) and got[1] == (0, 0, 0)
    assert got[2] == pytest.approx((1 / 2, 1 / 3, 0.4))


def test_group_advantage(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 2.0)], "g string, reward double")
    got = sorted(round(r["advantage"], 4) for r in E.group_advantage(df, "g").collect())
    assert got == [-1.0, 0.0, 0.0, 1.0]


def plain_runs(values, high):
    out, at = [], None
    for i, v in enumerate([*values, None]):
        if v is not None and high(v):
            at = i if at is None else at
        elif at is not None:
            out.append((at, i))
            at = None
    return out


@pytest.mark.parametrize("chunk", [10, 16, 64, 4096])
def test_hot_board_is_cut_into_chunks(spark, chunk):
    """One board with nine tenths of the samples, gaps in time and runs over many chunks: results as over whole series."""
    import random

    rng = random.Random(chunk)
    series = {1: [], 2: [1.0], 3: [9.0] * 50}
    while len(series[1]) < 900:
        series[1] += [rng.choice([0.0, 1.0, 2.0, 5.0, 10.0])] * rng.choice([1, 1, 2, 3, 9, 40, 130])
    series[4] = [float(rng.choice([0, 4, 9])) for _ in range(60)]
    times = {b: (sorted(rng.sample(range(5000), len(v))) if b == 1 else list(range(len(v)))) for b, v in series.items()}
    m = spark.createDataFrame([(b, t, v) for b in series for t, v in zip(times[b], series[b], strict=True)], "board long, t long, bbe double").repartition(7)

    got = sorted(map(tuple, M.islands(m, F.col("bbe") > 4, chunk).select("board", "start", "stop", "length").collect()))
    want = sorted((b, times[b][i], times[b][j - 1] + 1, j - i) for b, v in series.items() for i, j in plain_runs(v, lambda x: x > 4))
    assert got == want
    before = {(r["board"], r["t"]): r["p"] for r in M.previous(m, "bbe", "p", chunk=chunk).collect()}
    assert before == {(b, t): (series[b][i - 1] if i else None) for b in series for i, t in enumerate(times[b])}
    total = {(r["board"], r["t"]): r["s"] for r in M.running_total(m, "bbe", "s", chunk=chunk).collect()}
    assert total == {(b, t): sum(series[b][: i + 1]) for b in series for i, t in enumerate(times[b])}
    smooth = {(r["board"], r["t"]): r["smooth"] for r in M.smooth(m, chunk).collect()}
    assert smooth == {(b, t): pytest.approx(sum(series[b][max(0, i - 5) : i + 5]) / 10) for b in series for i, t in enumerate(times[b])}
    if chunk < 4096:
        for f in (M.burst_regions, M.local_alarms, lambda m, chunk=M.CHUNK: M.pattern_kind(m, 12, 2, 20, chunk), lambda m, chunk=M.CHUNK: M.threshold_spans(m, 0.5, 2, chunk)):
            assert sorted(map(str, f(m, chunk=chunk).collect())) == sorted(map(str, f(m).collect()))


def test_windows_hold_a_chunk(spark):
    """No window of samples is partitioned by the board alone."""
    import re

    m = spark.createDataFrame([(1, 1, 1.0)], "board long, t long, bbe double")
    for df in (M.burst_regions(m), M.pattern_kind(m), M.local_alarms(m), M.smooth(m), M.threshold_spans(m, 1.0, 2), M.zscore_baseline(m, 5)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        specs = re.findall(r"windowspecdefinition\(([^)]*?)specified", plan)
        assert not any(re.match(r"board#\d+L?, (t|start)#", s) for s in specs)


def test_similar_cases_equal_all_pairs(spark):
    """Copies, ties on both sides, peaks closer than rounding tells apart, nulls and far ones, against plain loops."""
    rng = random.Random(8)
    peaks = [5.0, 5.1, 4.9, 5.0 + 1e-9, 5.0 + 3e-8, 13.0, 13.1, -3.0, 700.0, 707.9, 1e9, None, float("nan"), float("inf")]
    rows = [(i, rng.choice(["OA", "XCON", None]), rng.choice(["step", "ramp", None]), rng.choice([*peaks, round(rng.random() * 20, 1)])) for i in range(400)]
    want = {}
    for q, kind, pattern, peak in rows:
        found = []
        for c, c_kind, c_pattern, c_peak in rows:
            if q != c and None not in (peak, c_peak) and abs(peak - c_peak) <= 8.0:
                score = (0.4 if pattern and pattern == c_pattern else 0.0) + (0.3 if kind and kind == c_kind else 0.0) + 0.3 * max(0.0, 1 - abs(peak - c_peak) / 8.0)
                found.append((-round(score, 9), c))
        want |= {(q, n): (c, -s) for n, (s, c) in enumerate(sorted(found)[:3], 1)}
    df = spark.createDataFrame(rows, "case_id long, kind string, pattern string, peak double")
    got = R.similar_cases(df, df.withColumnRenamed("case_id", "q_id"), 8.0, 3).collect()
    assert {(r["q_id"], r["rank"]): (r["case_id"], r["score"]) for r in got} == want


def test_pairs_of_similar_cases_grow_with_the_questions(spark):
    """All peaks lie within the span, so every question met every case; now each meets a bounded number."""
    for n in (500, 2000):
        df = spark.range(n).select(F.col("id").alias("case_id"), F.lit("OA").alias("c_kind"), F.lit("step").alias("c_pattern"), (F.col("id") * 8.0 / n).alias("c_peak"))
        asked = df.toDF("q_id", "kind", "pattern", "peak")
        assert n * 4 <= R.near_cases(df, asked, 8.0, 3).count() <= n * 10
