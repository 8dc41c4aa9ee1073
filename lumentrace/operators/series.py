"""Metric series per board: (board, t, bbe).

A series is cut into chunks of ``CHUNK`` time steps, and windows hold one chunk of one board, so a board with a large share of all
samples is many tasks' work. What crosses a chunk's edge (the last value, a run still open, a count so far) is carried
by a second pass over a row per chunk. What a sample needs of its whole series is an aggregate that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .preparation import ranked


#: Time steps of a series that one window holds.
CHUNK = 4096


def per_board(m: DataFrame, **of: Column) -> DataFrame:
    """``m`` with aggregates of each board's series."""
    return m.join(m.groupBy("board").agg(*[c.alias(n) for n, c in of.items()]), "board")


def _cut(m: DataFrame, order: str, chunk: int) -> tuple[DataFrame, WindowSpec]:
    return m.withColumn("_chunk", F.floor(F.col(order) / chunk)), W.partitionBy("board", "_chunk").orderBy(order)


def _chunks() -> WindowSpec:
    """Chunks of a board in order."""
    return W.partitionBy("board").orderBy("_chunk")


def previous(m: DataFrame, value: str, name: str, order: str = "t", chunk: int = CHUNK) -> DataFrame:
    """``m`` with each sample's ``value`` one before it as ``name``, null for a board's first; ``order`` tells a board's samples apart."""
    c, inside = _cut(m, order, chunk)
    ends = c.groupBy("board", "_chunk").agg(F.max_by(value, order).alias("_end"))
    ends = ends.select("board", "_chunk", F.lag("_end").over(_chunks()).alias("_end"))
    c = c.withColumns({name: F.lag(value).over(inside), "_place": F.row_number().over(inside)}).join(ends, ["board", "_chunk"])
    return c.withColumn(name, F.when(F.col("_place") > 1, F.col(name)).otherwise(F.col("_end"))).drop("_chunk", "_place", "_end")


def running_total(m: DataFrame, value: str, name: str, order: str = "t", chunk: int = CHUNK) -> DataFrame:
    """``m`` with the sum of ``value`` up to and with each sample as ``name``."""
    c, inside = _cut(m, order, chunk)
    before = c.groupBy("board", "_chunk").agg(F.sum(value).alias("_sum"))
    before = before.select("board", "_chunk", F.coalesce(F.sum("_sum").over(_chunks().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    c = c.withColumn(name, F.sum(value).over(inside)).join(before, ["board", "_chunk"])
    return c.withColumn(name, F.col(name) + F.col("_before")).drop("_chunk", "_before")


def board_max(m: DataFrame) -> DataFrame:
    return m.groupBy("board").agg(F.max("bbe").alias("bbe_max"))


def board_rank(m: DataFrame) -> DataFrame:
    """Rank of each board by its maximum, from a range-partitioned sort."""
    return ranked(board_max(m), F.desc("bbe_max"), F.col("board")).select("board", "bbe_max", F.col("k").cast("int").alias("rank"), F.col("n").alias("n_boards"))


def top_boards(m: DataFrame, n: int) -> DataFrame:
    return board_max(m).orderBy(F.desc("bbe_max"), "board").limit(n)


def threshold(peak: Column) -> Column:
    return F.greatest(peak * 0.5, F.lit(5.0))


def board_metrics(m: DataFrame) -> DataFrame:
    high = F.col("bbe") > threshold(F.col("peak"))
    return per_board(m, peak=F.max("bbe")).groupBy("board").agg(F.max("bbe").alias("bbe_max"), F.count(F.lit(1)).alias("samples"), F.count_if(high).alias("elevated"), F.avg(F.when(high, 1.0).otherwise(0.0)).alias("elevated_frac"))


def islands(m: DataFrame, high: Column, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of samples with ``high``: board, start, stop (exclusive), length.

    Runs are found inside chunks first. One that is open at a chunk's end goes on in the board's next chunk if that begins high; which
    run a chunk's first part belongs to follows from the chunks' ends, and the parts of a run are added up.
    """
    c, inside = _cut(m.withColumn("_high", F.coalesce(high, F.lit(False)).cast("int")), "t", chunk)
    opens = (F.col("_high") == 1) & (F.coalesce(F.lag("_high").over(inside), F.lit(0)) == 0)
    c = c.withColumn("_opens", opens.cast("int")).withColumn("_k", F.sum("_opens").over(inside))
    parts = c.filter("_high = 1").groupBy("board", "_chunk", "_k").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop"), F.count(F.lit(1)).alias("length"))
    ends = c.groupBy("board", "_chunk").agg(F.min_by("_high", "t").alias("first"), F.max_by("_high", "t").alias("last"), F.min("_high").alias("all"), F.max("_k").alias("k"))
    ends = ends.withColumn("goes_on", (F.col("first") == 1) & (F.coalesce(F.lag("last").over(_chunks()), F.lit(0)) == 1))
    # A chunk that a run fills from end to end hands on what came to it; any other its own last run.
    own = F.when(~(F.col("goes_on") & (F.col("all") == 1)), F.struct(F.col("_chunk").alias("c"), F.col("k").alias("k")))
    ends = ends.withColumn("own", own).withColumn("run", F.last("own", ignorenulls=True).over(_chunks().rowsBetween(W.unboundedPreceding, -1)))
    j = parts.join(ends.filter("goes_on").select("board", "_chunk", "run"), ["board", "_chunk"], "left")
    run = F.when(F.col("run").isNotNull() & (F.col("_k") == 1), F.col("run")).otherwise(F.struct(F.col("_chunk").alias("c"), F.col("_k").alias("k")))
    return j.withColumn("run", run).groupBy("board", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("length").alias("length")).drop("run")


def burst_regions(m: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs above half the peak: their number, and the longest one's share."""
    runs = islands(per_board(m, peak=F.max("bbe")), F.col("bbe") > threshold(F.col("peak")), chunk)
    g = runs.groupBy("board").agg(F.count(F.lit(1)).alias("burst_regions"), (F.max("length") / F.sum("length")).alias("longest_burst_frac"))
    return m.select("board").distinct().join(g, "board", "left").select("board", F.coalesce("burst_regions", F.lit(0)).alias("burst_regions"), F.coalesce("longest_burst_frac", F.lit(0.0)).alias("longest_burst_frac"))


def pattern_kind(m: DataFrame, gap: int = 500, width: int = 15, least: int = 100, chunk: int = CHUNK) -> DataFrame:
    """step, ramp, step_recovery or burst, from the runs above 0.9 of the peak in their widest cluster."""
    df = per_board(m, peak=F.max("bbe"), samples=F.count(F.lit(1))).filter(F.col("samples") >= least)
    runs = previous(islands(df, F.col("bbe") > F.col("peak") * 0.9, chunk), "stop", "before", "start", chunk)
    runs = running_total(runs.withColumn("apart", F.when(F.col("start") - F.col("before") > gap, 1).otherwise(0)), "apart", "cluster", "start", chunk)
    per = runs.groupBy("board", "cluster").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("length").alias("total"), F.min("start").alias("first"), F.max("stop").alias("last"))
    best = per.groupBy("board").agg(F.min_by(F.struct("n_runs", "total", "first", "last"), F.struct(-F.col("total"), "cluster")).alias("c")).select("board", "c.*")
    # Between the runs of the cluster: inside its span and not above the threshold.
    inside = df.join(best, "board", "left").filter((F.col("t") >= F.col("first")) & (F.col("t") < F.col("last")) & (F.col("bbe") <= F.col("peak") * 0.9))
    between = inside.groupBy("board").agg(F.avg("bbe").alias("inter_mean"))
    peaks = df.groupBy("board").agg(F.max("peak").alias("bbe_max"))
    j = peaks.join(best, "board", "left").join(between, "board", "left")
    n = F.coalesce("n_runs", F.lit(0))
    kind = F.when((n <= 1) & (n == 1) & (F.col("total") > width), "step").when(n <= 1, "ramp").when(F.col("inter_mean") > F.col("bbe_max") * 0.7, "step_recovery").otherwise("burst")
    return j.select("board", "bbe_max", n.alias("n_runs"), "inter_mean", kind.alias("pattern_kind"))


def local_alarms(m: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SPIKE or SHIFT where a value is high and has risen; the first sample has not."""
    d = F.coalesce(F.col("bbe") - F.col("_before"), F.lit(0.0))
    kind = F.when((F.col("bbe") >= 4) & (F.col("d") >= 2), "SPIKE").when((F.col("bbe") >= 2) & (F.col("d") >= 1), "SHIFT")
    rises = previous(m, "bbe", "_before", chunk=chunk).withColumn("d", d).withColumn("alarm", kind).filter("alarm is not null")
    return rises.select("board", "t", "bbe", "alarm", F.when(F.col("alarm") == "SPIKE", "Major").otherwise("Minor").alias("severity"))


def smooth(m: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Ten-sample moving sum over -5..+4, zeros beyond the ends, divided by ten.

    Samples are numbered, and blocks of ``chunk`` (ten or more) of them get copies of the five before and the four after.
    """
    n = running_total(m.withColumn("_one", F.lit(1)), "_one", "_r", chunk=chunk).withColumn("_r", F.col("_r") - 1)
    place = F.col("_r") % chunk
    also = F.array_compact(F.array(F.lit(0), F.when(place < 4, -1), F.when(place >= chunk - 5, 1)))
    n = n.withColumn("_to", F.explode(also)).withColumn("_block", F.floor(F.col("_r") / chunk) + F.col("_to"))
    w = W.partitionBy("board", "_block").orderBy("t")
    return n.withColumn("smooth", F.sum("bbe").over(w.rowsBetween(-5, 4)) / 10).filter("_to = 0").drop("_one", "_r", "_to", "_block")


def derive_bber_es(m: DataFrame) -> DataFrame:
    s = smooth(m)
    es = F.least(F.greatest(F.col("smooth") / 9, F.lit(0.0)), F.lit(1.0))
    return s.select("board", "t", "bbe", (F.col("smooth") / 1000).alias("bber"), es.alias("es"), F.when(es > 0.5, 1).otherwise(0).alias("ses"))


def zscore_baseline(m: DataFrame, before: int) -> DataFrame:
    """Distance from the mean of the samples before ``before``, in their sample deviations (0 counts as 1)."""
    base = F.when(F.col("t") < before, F.col("bbe"))
    df = per_board(m, _mean=F.avg(base), _sd=F.stddev_samp(base))
    return df.select("board", "t", (F.abs(F.col("bbe") - F.col("_mean")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)).alias("z"))


def pseudo_anomaly(m: DataFrame, k: int) -> DataFrame:
    """The k most unusual samples of each board by global z-score; earliest first among equals. Tasks cut to k before rows are exchanged."""
    df = per_board(m, _mean=F.avg("bbe"), _sd=F.stddev_pop("bbe"))
    z = df.withColumn("z", F.round(F.abs(F.col("bbe") - F.col("_mean")) / F.greatest(F.col("_sd"), F.lit(1e-9)), 6))
    return z.withColumn("place", F.row_number().over(W.partitionBy("board").orderBy(F.desc("z"), "t"))).filter(F.col("place") <= k).select("board", "t", "z", "place")


def series_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("board").agg(F.avg("bbe").alias("mean"), F.stddev_pop("bbe").alias("sd"), F.percentile("bbe", F.lit(0.95)).alias("p95"), F.max("bbe").alias("max"))


def threshold_spans(m: DataFrame, k: float, least: int, chunk: int = CHUNK) -> DataFrame:
    """Runs of ``least`` samples or more above mean + k deviations."""
    df = per_board(m, mu=F.avg("bbe"), sd=F.stddev_pop("bbe"))
    return islands(df, F.col("bbe") >= F.round(F.col("mu") + F.col("sd") * k, 9), chunk).filter(F.col("length") >= least).select("board", "start", "stop", "length")


def worst_case(m: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group and t: largest and mean value over its boards. ``groups``: board, grp."""
    return m.join(groups, "board").groupBy("grp", "t").agg(F.max("bbe").alias("worst"), F.avg("bbe").alias("mean"))


def alarms_after_failure(events: DataFrame, seconds: int) -> DataFrame:
    """Per failure: other alarms of its board in the time after it. Board and time bucket are the equi keys.

    An alarm within ``seconds`` of a failure lies in the failure's bucket or the next, so both are looked up and
    the exact times decide; the join never meets more than two buckets of a board.
    """
    bucket = F.floor(F.unix_seconds("ts") / seconds)
    fails = events.filter(F.col("alarm") == "error").select("event_id", "board", F.col("ts").alias("failed_at"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    others = events.filter(F.col("alarm") != "error").select(F.col("board"), F.col("ts"), "alarm", bucket.alias("bucket"))
    near = fails.join(others, ["board", "bucket"]).filter((F.col("ts") >= F.col("failed_at")) & (F.unix_micros("ts") <= F.unix_micros("failed_at") + seconds * 1_000_000))
    g = near.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_after"), F.countDistinct("alarm").alias("kinds"))
    return events.filter(F.col("alarm") == "error").select("event_id", "board").join(g, "event_id", "left").select("event_id", "board", F.coalesce("n_after", F.lit(0)).alias("n_after"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


def failure_windows(events: DataFrame, context_s: int) -> DataFrame:
    """Samples from ``context_s`` before a board's first failure to as much after its last."""
    span = events.filter(F.col("alarm") == "error").groupBy("board").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    j = events.join(span, "board").filter((F.unix_micros("ts") >= F.unix_micros("first") - context_s * 1_000_000) & (F.unix_micros("ts") <= F.unix_micros("last") + context_s * 1_000_000))
    return j.groupBy("board").agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("peak"))


def stagger(intervals: DataFrame, gap: int) -> DataFrame:
    """Per node: starts moved so that none begins before the last end plus ``gap``. (node, id, t0, dur) -> shifted start.

    With C the running sum of dur + gap before a row, the start is C plus the running maximum of t0 - C.
    """
    w = W.partitionBy("node").orderBy("t0", "id")
    c = intervals.withColumn("c", F.coalesce(F.sum(F.col("dur") + gap).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return c.select("node", "id", "t0", "dur", (F.col("c") + F.max(F.col("t0") - F.col("c")).over(w.rowsBetween(W.unboundedPreceding, 0))).alias("start"))


def affected_boards(m: DataFrame, split: int, least: float) -> DataFrame:
    """Boards whose mean rises by ``least`` from sample ``split`` on."""
    g = m.groupBy("board").agg(F.avg(F.when(F.col("t") >= split, F.col("bbe"))).alias("after"), F.avg(F.when(F.col("t") < split, F.col("bbe"))).alias("before"))
    return g.withColumn("delta", F.round(F.col("after") - F.col("before"), 6)).filter(F.col("delta") >= least).select("board", "delta")


def overlay(m: DataFrame, windows: DataFrame) -> DataFrame:
    """Alarm windows (board, start, stop, amplitude) laid over the series: the larger of sample and amplitude.

    Windows are exploded to buckets of 64 samples, so board and bucket are the equi keys of a range join.
    """
    size = 64
    w = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    hit = m.select("board", "t", F.floor(F.col("t") / size).alias("bucket")).join(w, ["board", "bucket"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    top = hit.groupBy("board", "t").agg(F.max("amplitude").alias("amplitude"))
    return m.join(top, ["board", "t"], "left").select("board", "t", F.greatest("bbe", F.coalesce("amplitude", "bbe")).alias("bbe"))


def stream_alarms_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Bursts as sessions of events with no longer pause than ``gap``; runs on batches and streams alike."""
    return events.groupBy(F.session_window("ts", gap).alias("s"), "board").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select("board", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n", "peak")
