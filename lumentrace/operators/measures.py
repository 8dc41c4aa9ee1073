"""Three counters per board and step (bbe, bber, es): features, anomalies, windows and what failures add.

Windows hold one board's series, as in ``series``; ranks over boards come from range-partitioned sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import series as M
from .preparation import ranked

METRICS = ("bbe", "bber", "es")
#: Event, shape, amplitude, bber and es multipliers, board kind, role, peak.
EVENT_SHAPES = (
    ("Fiber_Cut", "step", 5.5, 3.0, 0.6, "OA", "", 55.0),
    ("Fiber_Crack", "step_recovery", 3.5, 5.5, 0.4, "OA", "", 42.0),
    ("Fiber_Aging", "ramp", 2.8, 2.0, 0.7, "OA", "", 28.0),
    ("Line_Disconnect", "step_recovery", 3.0, 1.2, 0.8, "LINE", "SRC", 36.0),
    ("XCON_Port_Down", "step", 3.2, 2.8, 0.6, "XCON", "SRC", 32.0),
    ("XCON_Buffer_Overflow", "burst", 4.6, 3.0, 0.5, "XCON", "SRC", 46.0),
    ("XCON_Fabric_Fault", "step_recovery", 4.2, 3.2, 0.55, "XCON", "SRC", 50.4),
)


def event_shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_SHAPES, "event string, shape string, mult double, bber_mult double, es_mult double, kind string, role string, peak double")


def board_measures(m: DataFrame) -> DataFrame:
    """Maxima of the three counters, samples, and samples above the burst threshold."""
    peaks = m.groupBy("board").agg(*[F.max(c).alias(f"{c}_max") for c in METRICS], F.count(F.lit(1)).alias("samples"))
    high = M.per_board(m, peak=F.max("bbe")).groupBy("board").agg(F.count_if(F.col("bbe") > M.threshold(F.col("peak"))).alias("elevated"))
    return peaks.join(high, "board")


def pattern_features(m: DataFrame, gap: int = 500, width: int = 15, least: int = 100) -> DataFrame:
    """The features of every board with ``least`` samples or more, rounded as they are written."""
    df = M.per_board(m, _n=F.count(F.lit(1))).filter(F.col("_n") >= least).drop("_n")
    g = df.groupBy("board").agg(F.max("bbe").alias("_bbe"), F.max("bber").alias("_bber"), F.avg(F.when(F.col("es") > 0.5, 1.0).otherwise(0.0)).alias("_es"))
    j = g.join(M.burst_regions(df), "board").join(M.pattern_kind(df, gap, width, least).select("board", "pattern_kind"), "board")
    return j.select(
        "board", F.round("_bbe", 1).alias("bbe_max"), "burst_regions", F.round("longest_burst_frac", 3).alias("longest_burst_frac"), F.round("_es", 4).alias("es_frac"),
        F.when(F.col("_bbe") > 0, F.round(F.col("_bber") / F.col("_bbe") * 1000, 2)).alias("bber_bbe_ratio"), "pattern_kind",
    )


def peak_features(m: DataFrame, gap: int = 500, width: int = 15, least: int = 100) -> DataFrame:
    """Features of the board with the highest peak; if it has too few samples, of the highest one that has enough."""
    f = pattern_features(m, gap, width, least)
    top = M.board_max(m).agg(F.max_by("board", F.struct("bbe_max", -F.col("board"))).alias("peak_board"))
    order = F.struct((F.col("board") == F.col("peak_board")).alias("a"), "bbe_max", (-F.col("board")).alias("b"))
    best = f.crossJoin(F.broadcast(top)).groupBy("peak_board").agg(F.max_by(F.struct(*f.columns), order).alias("x"))  # one row on the right
    return best.select("peak_board", "x.*")


def missing_board_help(asked: DataFrame, m: DataFrame, n: int = 20) -> DataFrame:
    """Asked boards without samples, and the first ``n`` names that have some."""
    known = m.select("board").distinct()
    some = known.orderBy("board").limit(n).agg(F.array_join(F.transform(F.sort_array(F.collect_list("board")), lambda b: b.cast("string")), ",").alias("available"))
    return asked.join(known, "board", "left_anti").crossJoin(F.broadcast(some))


def event_derived(m: DataFrame, shapes: DataFrame) -> DataFrame:
    """bber and es of boards with an event (m: board, t, bbe, event): the plain ones times the event's multiplier, es from a lowered threshold."""
    s = M.smooth(m).join(shapes.select("event", "bber_mult", "es_mult"), "event", "left")
    bber = F.col("smooth") / 1000 * F.coalesce("bber_mult", F.lit(1.0))
    es = F.least(F.greatest(F.col("smooth") / (9 * F.coalesce("es_mult", F.lit(1.0))), F.lit(0.0)), F.lit(1.0))
    return s.select("board", "t", "bbe", bber.alias("bber"), es.alias("es"), F.when(F.col("smooth") >= 9 * F.coalesce("es_mult", F.lit(1.0)), 1).otherwise(0).alias("es_hard"))


def zscores(m: DataFrame, before: int, alpha: float) -> DataFrame:
    """Largest distance of the three counters from their means before ``before``, in sample deviations (0 counts as 1), times ``alpha``."""

    base = {c: F.when(F.col("t") < before, F.col(c)) for c in METRICS}
    df = M.per_board(m, **{f"_mean_{c}": F.avg(v) for c, v in base.items()}, **{f"_sd_{c}": F.stddev_samp(v) for c, v in base.items()})
    z = [F.abs(F.col(c) - F.col(f"_mean_{c}")) / F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(1.0) for c in METRICS]
    return df.select("board", "t", (F.greatest(*z) * alpha).alias("z"))


def anomalies(m: DataFrame) -> DataFrame:
    """Largest distance of the three counters from a board's means, in population deviations."""
    df = M.per_board(m, **{f"_mean_{c}": F.avg(c) for c in METRICS}, **{f"_sd_{c}": F.stddev_pop(c) for c in METRICS})
    z = [F.abs(F.col(c) - F.col(f"_mean_{c}")) / F.greatest(F.col(f"_sd_{c}"), F.lit(1e-9)) for c in METRICS]
    return df.select("board", "t", F.round(F.greatest(*z), 6).alias("score"))


def top_times(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each board (a report's top list), and the earliest of their times."""
    top = scored.withColumn("place", F.row_number().over(W.partitionBy("board").orderBy(F.desc("score"), "t"))).filter(F.col("place") <= k)
    return top.select("board", "t", "score", "place", F.min("t").over(W.partitionBy("board")).alias("earliest"))


def window_slice(m: DataFrame, spans: DataFrame, context: int) -> DataFrame:
    """Samples from ``context`` steps before a board's first failure to as many after its last end. ``spans``: board, first, last."""
    j = m.join(spans, "board").filter((F.col("t") >= F.col("first") - context) & (F.col("t") <= F.col("last") + context))
    return j.select("board", "t", *METRICS, ((F.col("t") >= F.col("first")) & (F.col("t") <= F.col("last"))).alias("in_failure"))


def side_by_side(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs' series of the same boards and steps."""
    b = other.select("board", "t", *[F.col(c).alias(f"{c}_b") for c in METRICS])
    return one.select("board", "t", *METRICS).join(b, ["board", "t"], "full")


def alarms_after(failures: DataFrame, alarms: DataFrame, seconds: int, top: int = 5) -> DataFrame:
    """Per failure (event_id, board, ts) a line on the alarms (board, ts, alarm) of its board in the time after it, with the ``top`` names."""
    bucket = F.floor(F.unix_seconds("ts") / seconds)
    f = failures.select("event_id", "board", F.col("ts").alias("at"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    near = f.join(alarms.select("board", "ts", "alarm", bucket.alias("bucket")), ["board", "bucket"]).filter((F.col("ts") >= F.col("at")) & (F.unix_micros("ts") <= F.unix_micros("at") + seconds * 1_000_000))
    kinds = near.groupBy("event_id", "alarm").agg(F.count(F.lit(1)).alias("c"))
    g = kinds.groupBy("event_id").agg(F.sum("c").alias("n"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("m"), "alarm"))), 1, top).alias("x"))
    names = F.array_join(F.transform("x", lambda t: F.concat(t["alarm"], F.lit("="), (-t["m"]).cast("string"))), ",")
    said = F.concat(F.lit("alarms="), F.col("n").cast("string"), F.lit(" top="), names)
    return failures.select("event_id", "board").join(g, "event_id", "left").select("event_id", "board", F.coalesce(said, F.lit("no local alarms in the window")).alias("line"))


def shaped_overlay(m: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows (board, start, stop, amplitude, shape) laid over bbe, the larger value counting: a step holds its amplitude, a ramp rises to it.

    Windows are exploded to buckets of 64 samples, so board and bucket are the keys of the range join.
    """
    size = 64
    w = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    hit = m.select("board", "t", F.floor(F.col("t") / size).alias("bucket")).join(w, ["board", "bucket"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    level = F.when(F.col("shape") == "ramp", F.col("amplitude") * (F.col("t") - F.col("start") + 1) / (F.col("stop") - F.col("start"))).otherwise(F.col("amplitude"))
    top = hit.groupBy("board", "t").agg(F.max(level).alias("level"))
    return m.join(top, ["board", "t"], "left").select("board", "t", F.greatest("bbe", F.coalesce("level", "bbe")).alias("bbe"))


def sum_deltas(base: DataFrame, overlays: DataFrame) -> DataFrame:
    """Baseline plus the sum of what each failure's overlay (failure, board, t, bbe) adds to it."""
    d = overlays.join(base.select("board", "t", F.col("bbe").alias("b")), ["board", "t"]).groupBy("board", "t").agg(F.sum(F.col("bbe") - F.col("b")).alias("delta"))
    return base.join(d, ["board", "t"], "left").select("board", "t", (F.col("bbe") + F.coalesce("delta", F.lit(0.0))).alias("bbe"))


def most_affected(m: DataFrame, split: int, least: float, n: int, failed: DataFrame) -> DataFrame:
    """The ``n`` boards (a report's top list) whose mean rises most from sample ``split`` on, by ``least`` at least, on their best counter; failed boards always."""

    def rise(c: str) -> Column:
        return F.round(F.avg(F.when(F.col("t") >= split, F.col(c))) - F.avg(F.when(F.col("t") < split, F.col(c))), 6)

    g = m.groupBy("board").agg(*[rise(c).alias(c) for c in METRICS])
    g = g.unpivot("board", list(METRICS), "metric", "delta").filter("delta is not null")
    g = g.groupBy("board").agg(F.max_by(F.struct("metric", "delta"), F.struct("delta", "metric")).alias("x")).select("board", "x.metric", "x.delta")
    hit = failed.select("board").distinct().withColumn("failed", F.lit(True))
    g = g.join(hit, "board", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    top = g.filter(~F.col("failed") & (F.col("delta") >= least)).orderBy(F.desc("delta"), "board").limit(n)
    return top.unionByName(g.filter("failed"))


def flow_boards(flow: DataFrame) -> DataFrame:
    """Boards of a flow (board, role, start, stop, ord): their place by first appearance, first role given, and distinct windows in order."""
    g = flow.groupBy("board").agg(
        F.min("ord").alias("first"), F.min_by("role", F.when(F.coalesce("role", F.lit("")) != "", F.col("ord"))).alias("role"), F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("w")
    )
    text = F.array_join(F.transform("w", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), ",")
    return ranked(g.select("board", "first", "role", text.alias("windows")), F.col("first"), F.col("board")).select("board", F.col("k").alias("place"), "role", "windows")
