"""Masking, sampling and splitting, all by integer hashes: equal in every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.sources.storage import materialise


def draw(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of non-negative ids."""
    return F.pmod(key.cast("long") * 2654435761 + seed, F.lit(1000003))


def ranked(df: DataFrame, *order: Column, of: str | None = None, name: str = "k") -> DataFrame:
    """``k`` (or ``name``) from 1 along ``order``, and ``n`` rows in all; with ``of`` only rows where it is 1, not 0, count.

    Ranks come from a range-partitioned sort: rows are numbered inside their partitions and shifted by the counts
    of those before, so no task sees more than its range. The partitions are written down, as the ranges are
    drawn anew whenever they are computed.
    """
    placed = materialise(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("_p").orderBy(*order)
    inner = placed.withColumn("_k", F.row_number().over(inside) if of is None else F.sum(of).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    counts = placed.groupBy("_p").agg((F.count(F.lit(1)) if of is None else F.sum(of)).alias("_c"))
    w = W.orderBy("_p")
    shift = counts.select("_p", F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_c").over(W.partitionBy()).alias("n"))
    return inner.join(shift, "_p").withColumn(name, F.col("_k") + F.col("_s")).drop("_p", "_k", "_s")


def mask_boards(m: DataFrame, frac: float, seed: int) -> DataFrame:
    """Drop all samples of a fraction of the boards, the one with the highest peak always among them."""
    g = m.groupBy("board").agg(F.max("bbe").alias("peak"))
    top = g.agg(F.max_by("board", F.struct("peak", -F.col("board"))).alias("top"))
    first = F.when(F.col("board") == F.col("top"), 0).otherwise(1)
    r = ranked(g.crossJoin(F.broadcast(top)), first, draw(F.col("board"), seed), F.col("board"))  # one row on the right
    return m.join(r.filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * frac))).select("board"), "board", "left_anti")


def train_val_split(df: DataFrame, id_col: str, frac: float, seed: int) -> DataFrame:
    """Ids with ``train`` or ``val``; val is never empty."""
    r = ranked(df.select(id_col), draw(F.col(id_col), seed), F.col(id_col))
    train = (F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * frac))) & (F.col("k") < F.col("n"))
    return r.select(id_col, F.when(train, "train").otherwise("val").alias("split"))


def inject_false_alarms(windows: DataFrame, ratio: float, boards: int, seed: int) -> DataFrame:
    """floor(ratio * max(1, n)) numbered false alarms per window, each on a drawn board."""
    n = F.floor(F.greatest(F.lit(1), F.col("n")) * ratio)
    x = windows.filter(n > 0).select("ow", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("i"))
    return x.select("ow", "i", (F.pmod(F.col("ow") * 31 + F.col("i") * 2654435761 + seed, F.lit(1000003)) % boards + 1).alias("board"))


def select_ids(df: DataFrame, id_col: str, spec: str) -> DataFrame:
    """Rows whose id lies in ranges such as ``0-9,12``; the ranges become one pushed-down predicate."""
    keep = F.lit(False)
    for part in spec.split(","):
        lo, _, hi = part.partition("-")
        keep = keep | F.col(id_col).between(int(lo), int(hi or lo))
    return df.filter(keep)


def trace_conversation(turns: DataFrame) -> DataFrame:
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("x"), F.count(F.lit(1)).alias("steps"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return g.select("conv_id", F.array_join(F.transform("x", lambda t: F.concat(t["role"], F.lit(":"), t["n"].cast("string"))), "|").alias("turns"), "steps", "answers")


def pick_distinct_nodes(failed: DataFrame, n: int, seed: int) -> DataFrame:
    """One failed board on each of ``n`` nodes."""
    w = W.partitionBy("node").orderBy(draw(F.col("board"), seed), "board")
    one = failed.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return one.orderBy(draw(F.col("board"), seed), "board").limit(n).select("board", "node")


def mask_uncovered(hops: DataFrame, metrics: DataFrame, boards: DataFrame, frac: float, seed: int) -> DataFrame:
    """Keep a fraction of the paths; samples of boards on nodes of no kept path become null."""
    paths = ranked(hops.select("path_id").distinct(), draw(F.col("path_id"), seed), F.col("path_id"))
    kept = paths.filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * frac))).select("path_id")
    nodes = hops.join(kept, "path_id", "left_semi").select("node").distinct().withColumn("on", F.lit(True))
    j = metrics.join(boards.select("board", "node"), "board").join(nodes, "node", "left")
    return j.select("board", "t", F.when(F.col("on"), F.col("bbe")).alias("bbe"))


def fingerprint(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.select(id_col, F.sha2(text, 256).alias("fingerprint"))
