"""Data-quality checks, one row each, and their scorecard."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks."""
    return left.distinct().join(right.distinct(), left.columns, "left_anti")


def _check(df: DataFrame, name: str, ok: Column) -> DataFrame:
    return df.agg(ok.alias("ok")).select(F.lit(name).alias("name"), "ok")


def checks(boards: DataFrame, hops: DataFrame, alarms: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    lengths = hops.groupBy("path_id").agg(n.alias("len"))
    on = boards.select("board").join(hops.select("board").distinct().withColumn("on", F.lit(1)), "board", "left")
    rows = [
        _check(boards, "boards", n >= 100),
        _check(boards, "nodes", F.countDistinct("node").between(5, 25)),
        _check(boards.filter("node is null"), "orphans", n == 0),
        _check(lengths, "paths", n >= 20),
        _check(lengths, "avg_hops", F.avg("len") >= 3),
        _check(hops.filter("n = 1"), "single_board_paths", n == 0),
        _check(on, "coverage", F.count("on") >= n * 0.8),
        _check(without(alarms.select("board"), boards.select("board")), "known_alarms", n == 0),
    ]
    return reduce(DataFrame.unionByName, rows)


def scorecard(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))


@dataclass(frozen=True)
class Limits:
    """Thresholds of the dataset checks."""

    boards: tuple[int, int] = (200, 500)
    nodes: tuple[int, int] = (5, 10)
    degree: tuple[float, float] = (1.8, 3.5)
    paths: tuple[int, int] = (20, 80)
    avg_hops: float = 5
    coverage: float = 0.8
    service_coverage: float = 0.95


#: Checks whose number passed is the score.
CORE = (1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 17, 18, 22)


def dataset_checks(boards: DataFrame, edges: DataFrame, hops: DataFrame, components: DataFrame, services: DataFrame, metrics: DataFrame, alarms: DataFrame, labels: DataFrame, limits: Limits | None = None, masked: bool = False) -> DataFrame:
    """All checks of a dataset, one row each: no, name, value, ok, core.

    boards (board, node), edges (src, dst), hops (path_id, board), components (board, component), services, metrics and
    alarms by window (ow; alarms: board, alarm, severity, hop, root_board, is_fp, rule_idx), labels (ow, root_board, root_event, failed_boards,
    k, coverage_fraction, noise_ratio). A table that lacks a column fails the check of its columns. With ``masked`` the
    service coverage is not asked for. Every check is one aggregate or anti-join.
    """
    limits = limits or Limits()
    n, rows = F.count(F.lit(1)), []

    def check(no: int, name: str, df: DataFrame, value: Column, ok) -> None:
        one = df.agg(value.cast("double").alias("value"))
        rows.append(one.select(F.lit(no).alias("no"), F.lit(name).alias("name"), "value", ok(F.col("value")).alias("ok"), F.lit(no in CORE).alias("core")))

    within = lambda pair: lambda v: v.between(*map(float, pair))
    none, some, at_least = (lambda v: v == 0), (lambda v: v > 0), (lambda x: lambda v: F.coalesce(v, F.lit(0.0)) >= x)
    check(1, "board_count", boards, n, within(limits.boards))
    check(2, "node_count", boards, F.countDistinct("node"), within(limits.nodes))
    check(3, "orphan_boards", boards.filter("node is null"), n, none)
    check(4, "connected_components", components, F.countDistinct("component"), lambda v: v == 1)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("board")).groupBy("board").agg(n.alias("d"))
    check(5, "avg_degree", ends, F.round(F.avg("d"), 2), within(limits.degree))
    lengths = hops.groupBy("path_id").agg(n.alias("len"))
    check(6, "path_count", lengths, n, within(limits.paths))
    check(7, "avg_path_hops", lengths.filter("len > 1"), F.avg(F.col("len") - 1), at_least(limits.avg_hops))
    on = boards.select("board").distinct().join(hops.select("board").distinct().withColumn("on", F.lit(1)), "board", "left")
    share = F.avg(F.coalesce("on", F.lit(0)))
    check(8, "path_coverage", on, share, at_least(limits.coverage))
    check(9, "boards_on_no_path", on.filter("on is null"), n, none)
    check(10, "single_board_paths", lengths.filter("len <= 1"), n, none)
    check(11, "service_coverage", on, share, at_least(0.0 if masked else limits.service_coverage))
    check(12, "services", services, n, some)
    check(13, "windows", labels, n, some)
    ow = labels.select("ow")
    gaps = without(ow, metrics.select("ow")).unionByName(without(ow, alarms.select("ow")))
    check(14, "windows_without_data", gaps, n, none)
    check(15, "metric_columns_missing", metrics.limit(1), F.lit(float(sum(c not in metrics.columns for c in ("ow", "board")))), none)
    check(16, "alarm_columns_missing", alarms.limit(1), F.lit(float(sum(c not in alarms.columns for c in ("board", "alarm", "severity", "is_fp")))), none)
    check(17, "labels_without_root", labels.filter("root_board is null"), n, none)
    check(18, "labels_without_failed", labels.filter("root_board is null and coalesce(size(failed_boards), 0) <= 0"), n, none)
    check(19, "regions_too_small", labels.filter("k >= 2 and coalesce(size(failed_boards), 0) < 2"), n, none)
    check(20, "coverage_fractions", labels, F.countDistinct("coverage_fraction"), some)
    check(21, "false_alarm_share", alarms, F.avg(F.when(F.col("is_fp"), 1.0).otherwise(0.0)), lambda v: v < 1)
    check(22, "labels_incomplete", labels.filter("root_board is null or coalesce(root_event, '') = ''"), n, none)
    failed = labels.select("ow", F.explode("failed_boards").alias("board")).distinct()
    seeds = alarms.filter("hop = 0").select("ow", "board")
    strange = without(alarms.filter("not is_fp").select("ow", F.col("root_board").alias("board")), failed)
    check(23, "failures_without_seed_or_strange_roots", without(failed, seeds).unionByName(strange), n, none)
    check(24, "propagated_rows", alarms.filter("rule_idx >= 0"), n, some)
    return reduce(DataFrame.unionByName, rows)


def core_score(checks: DataFrame) -> DataFrame:
    """Passed and total of the core checks."""
    return checks.filter("core").agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))
