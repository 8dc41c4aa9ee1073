"""Structured Streaming forms of the operators that live on arriving data.

Each takes a streaming DataFrame of alarms or samples (board, alarm, ts, value) and returns one; the batch operator of
the same name is its specification. State is bounded by watermarks; keys are boards, so it spreads as they do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumentrace.operators import series

LATE = "1 hour"


class _Rise(StatefulProcessor):
    """Holds a board's samples back until the watermark has passed them, then compares each with the one before it.

    A timer at each waiting time releases what is as old, in order of time and id; samples behind the watermark are dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double")
        self.waiting = handle.getListState("waiting", "event_id long, ts timestamp, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for df in rows:
            at = df["ts"].astype("datetime64[us]").astype("int64") // 1000
            fresh = df[at > mark] if mark > 0 else df
            for row in fresh[["event_id", "ts", "value"]].itertuples(index=False):
                self.waiting.appendValue((int(row.event_id), row.ts.to_pydatetime(), float(row.value)))
            for ms in sorted(set(at[fresh.index].tolist())):
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[1], r[0]))
        ready = [r for r in held if pd.Timestamp(r[1]).value // 1_000_000 <= until]
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for event_id, ts, value in ready:
            rise = value - (value if before is None else before)
            before = value
            alarm = "SPIKE" if value >= 4 and rise >= 2 else "SHIFT" if value >= 2 and rise >= 1 else None
            if alarm:
                out.append((key[0], event_id, ts, value, alarm))
        if ready:
            self.last.update((before,))
            rest = held[len(ready) :]
            self.waiting.put([tuple(r) for r in rest]) if rest else self.waiting.clear()
        return iter([pd.DataFrame(out, columns=["board", "event_id", "ts", "value", "alarm"])] if out else ())

    def close(self) -> None:
        pass


def stream_local_alarms(samples: DataFrame, late: str = LATE) -> DataFrame:
    """SPIKE and SHIFT per board in order of time, whatever order samples arrive in; those later than ``late`` are dropped.

    A sample's alarm comes out once the watermark has passed it. Needs the RocksDB state store; state holds a board's last value and
    the samples of the last ``late``.
    """
    return (
        samples.select("board", "event_id", "ts", "value")
        .withWatermark("ts", late)
        .groupBy("board")
        .transformWithStateInPandas(_Rise(), "board long, event_id long, ts timestamp, value double, alarm string", "Append", "EventTime")
    )


def stream_board_max(samples: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = samples.withWatermark("ts", LATE).groupBy(w.alias("w"), "board").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
    return g.select("board", F.col("w.start").alias("start"), "peak", "n")


def stream_bursts(samples: DataFrame, least: float, gap: str = "2 hours") -> DataFrame:
    """Sessions of samples above ``least``."""
    return series.stream_alarms_sessions(samples.withWatermark("ts", LATE).filter(F.col("value") > least), gap)


def stream_alarms_after_failure(alarms: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Failures with each alarm of their board in the time after, or with none: a left-outer interval join."""
    f = alarms.filter("alarm = 'error'").select(F.col("event_id").alias("failure_id"), F.col("board").alias("f_board"), F.col("ts").alias("failed_at")).withWatermark("failed_at", LATE)
    o = alarms.filter("alarm <> 'error'").select("event_id", "board", "ts", "alarm").withWatermark("ts", LATE)
    near = F.expr(f"f_board = board AND ts >= failed_at AND ts <= failed_at + INTERVAL {width}")
    return f.join(o, near, "left_outer").select("failure_id", "f_board", "failed_at", "event_id", "alarm")


def stream_flow_dedupe(alarms: DataFrame) -> DataFrame:
    return alarms.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["board", "alarm", "ts"])


def stream_ow_append(samples: DataFrame, path: str, checkpoint: str):
    """Append arriving samples as Parquet by day; exactly once through the checkpoint."""
    return samples.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
