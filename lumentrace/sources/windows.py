"""Observation windows as tables bucketed by window, and scores that a rerun replaces.

All parts of a dataset with a row or more a window are dealt to the same number of buckets by ``ow_id`` and sorted by it, so
joins of parts exchange nothing, and a filter on windows reads the buckets that hold them. Topology lies beside them in
plain files. What a write counts is observed while it runs, not read again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S

#: Columns of each part.
SCHEMAS = {
    "metrics": "ow_id long, domain_id int, board_id string, t int, BBE double, BBER double, ES double, SES int",
    "alarms": "ow_id long, alarms array<struct<board:string,alarm:string,severity:string,hop:int,arrival_time:string,root_board:string,root_event:string,is_fp:boolean>>",
    "labels": "ow_id long, domain_id int, root_board string, root_event string, failed_boards array<string>, failed_events array<string>, region_size_k int, severity string, failure_time timestamp, duration_ms long, noise_ratio double, n_gt_alarms int, n_fp_alarms int",
    "boards": "domain_id int, node_id string, board_id string, board_type string, layer string",
    "edges": "domain_id int, src_board_id string, dst_board_id string",
    "lightpaths": "path_id long, board_path array<string>, node_path array<string>, domain_id int",
    "services": "service_id string, src int, dst int, node_path array<int>, path_segments array<string>",
}
WINDOWED, STATIC = ("metrics", "alarms", "labels"), ("boards", "edges", "lightpaths", "services")


def _as(df: DataFrame, part: str) -> DataFrame:
    """The part's columns in order; those that ``df`` lacks are null."""
    wanted = df.sparkSession.createDataFrame([], SCHEMAS[part]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def domain_stats(boards: DataFrame, edges: DataFrame, lightpaths: DataFrame) -> DataFrame:
    """Per domain: nodes, boards, edges, paths and mean boards a path."""
    n = F.count(F.lit(1))
    b = boards.groupBy("domain_id").agg(F.countDistinct("node_id").alias("n_nodes"), n.alias("n_boards"))
    e = edges.groupBy("domain_id").agg(n.alias("n_edges"))
    p = lightpaths.groupBy("domain_id").agg(n.alias("n_paths"), F.avg(F.size("board_path")).alias("mean_boards"))
    return b.join(e, "domain_id", "left").join(p, "domain_id", "left").fillna(0, ["n_edges", "n_paths"])


def write_windows(parts: dict[str, DataFrame], root: str, name: str, buckets: int = 16) -> dict[str, int]:
    """Write all seven parts under ``root`` and give what was counted while writing; tables ``name_<part>`` stand for the windowed ones.

    ``alarms`` are rows, which are nested by window here. A dataset written before under the same root is replaced.
    """
    spark = parts["labels"].sparkSession
    rows = {k: _as(parts[k], k) for k in (*STATIC, "metrics", "labels")}
    flat = [f.split(":")[0] for f in SCHEMAS["alarms"].split("struct<")[1].rstrip(">").split(",")]
    have = parts["alarms"]
    nested = have.select("ow_id", F.struct(*[(F.col(c) if c in have.columns else F.lit(None)).alias(c) for c in flat]).alias("x"))
    rows["alarms"] = _as(nested.groupBy("ow_id").agg(F.array_sort(F.collect_list("x")).alias("alarms")), "alarms")
    counts: dict[str, int] = {}
    for part in STATIC:
        rows[part].write.mode("overwrite").json(f"{root}/{part}")
    domain_stats(*(rows[p] for p in ("boards", "edges", "lightpaths"))).write.mode("overwrite").json(f"{root}/domain_stats")
    for part in WINDOWED:
        seen = Observation(part)
        extra = {"metrics": [F.max("t").alias("last_t")], "alarms": [F.sum(F.size("alarms")).alias("n_alarms")], "labels": [F.count_if(F.col("root_board").isNull()).alias("unlabelled")]}[part]
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
        df = rows[part].observe(seen, F.count(F.lit(1)).alias("n"), *extra)
        df.repartition(buckets, "ow_id").write.mode("overwrite").format("parquet").bucketBy(buckets, "ow_id").sortBy("ow_id").option("path", f"{root}/{part}").saveAsTable(f"{name}_{part}")
        counts |= {f"{part}_{k}": int(v or 0) for k, v in seen.get.items()}
    spark.createDataFrame([(json.dumps(counts | {"buckets": buckets}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/stats")
    return counts


def read_windows(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """All parts of a dataset under ``root``, and its ``domain_stats`` and ``stats``; nothing is inferred from the data."""
    out = {p: spark.read.schema(SCHEMAS[p]).json(f"{root}/{p}") for p in STATIC}
    out["domain_stats"] = spark.read.schema("domain_id int, n_nodes long, n_boards long, n_edges long, n_paths long, mean_boards double").json(f"{root}/domain_stats")
    out["stats"] = spark.read.text(f"{root}/stats")
    buckets = json.loads(out["stats"].first()["value"])["buckets"]
    for part in WINDOWED:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{part} ({SCHEMAS[part]}) USING parquet CLUSTERED BY (ow_id) SORTED BY (ow_id) INTO {int(buckets)} BUCKETS LOCATION '{root}/{part}'")
        out[part] = spark.table(f"{name}_{part}")
    return out


def windows(parts: dict[str, DataFrame]) -> DataFrame:
    """Label, alarms and samples of each window side by side; a window without alarms has none."""
    m = parts["metrics"].groupBy("ow_id").agg(F.count(F.lit(1)).alias("samples"), F.max("BBE").alias("bbe_max"))
    none = F.array().cast(parts["alarms"].schema["alarms"].dataType)
    return parts["labels"].join(parts["alarms"], "ow_id", "left").join(m, "ow_id", "left").withColumn("alarms", F.coalesce("alarms", none))


#: Labels of a confusion table: the known events, and what is none of them.
LABELS = (*S.EVENTS, "(none)", "(other)")


def confusion(scores: DataFrame) -> DataFrame:
    """Counts of each label and prediction (gt_event, pred_event) per model, zeros included, a column per prediction."""
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "(none)").when(F.col(c).isin(*S.EVENTS), F.col(c)).otherwise("(other)")
    pairs = scores.select("model_name", known("gt_event").alias("gt"), known("pred_event").alias("pred"))
    every = scores.select("model_name").distinct().withColumn("gt", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    wide = pairs.groupBy("model_name", "gt").pivot("pred", list(LABELS)).agg(F.count(F.lit(1)))
    return every.join(wide, ["model_name", "gt"], "left").fillna(0, list(LABELS))


def summary(scores: DataFrame) -> DataFrame:
    """Per model: examples and means of the scores that the table has."""
    means = [c for c in ("event_correct", "board_correct", "category_correct", "board_f1", "alarm_f1", "severity_f1", "format_score", "e2e_score") if c in scores.columns]
    return scores.groupBy("model_name").agg(F.count(F.lit(1)).alias("n_examples"), *[F.round(F.avg(c), 6).alias(c) for c in means])


def write_scores(scores: DataFrame, root: str) -> dict[str, int]:
    """Add the scores of one or more models (``model_name``), their summary and confusion to those under ``root``.

    Each is partitioned by model, and a model that is written again replaces its own partition, so a rerun adds nothing twice.
    """
    seen = Observation("scores")
    for part, df in (("per_example", scores.observe(seen, F.count(F.lit(1)).alias("rows"))), ("summary", summary(scores)), ("confusion", confusion(scores))):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_name").parquet(f"{root}/{part}")
    return dict(seen.get)


def read_scores(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {part: spark.read.parquet(f"{root}/{part}") for part in ("per_example", "summary", "confusion")}
