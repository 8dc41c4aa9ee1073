"""Readers and writers of the domain's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentrace.functions import scalars as S
from lumentrace.operators.preparation import ranked

RULE_COLUMNS = ("from_type", "from_alarm", "action", "to_type", "to_alarm")
METRIC_SCHEMA = "t int, board string, BBE double, BBER double, ES double"
OUTPUT_SCHEMA = "sample_index int, model_output string, ground_truth_root_board string, ground_truth_root_event string, predicted_event string, agent_steps int, agent_tool_calls int, n_failures int, _corrupt string"
#: Logical column to the names files use for it, lower case without underscores.
ALIASES = {
    "board": ("board", "node", "boardname", "sourceboard"),
    "event": ("event", "alarm", "failure", "eventname"),
    "severity": ("severity", "level"),
    "time": ("time", "start", "timestamp", "starttime"),
    "duration_ms": ("durationms", "duration"),
    "role": ("boardrole", "role"),
}


def resolve_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Columns under their logical names; those a file lacks are null. The first alias that occurs counts."""
    have = {c.lower().replace("_", "").replace(" ", ""): c for c in reversed(df.columns)}
    out = []
    for name, options in aliases.items():
        hit = next((have[o] for o in options if o in have), None)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules with their index: comment lines count, blank lines do not, rows with an empty field are dropped.

    A rule file is one small file, which keeps its lines in order in one partition.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    parts = F.transform(F.split("line", ",", -1), lambda x: F.trim(x))
    df = lines.filter(F.col("n") > 0).select((F.col("n") - 1).alias("rule_idx"), "line", parts.alias("p"))
    df = df.filter(~F.col("line").startswith("#") & (F.size("p") >= 5) & ~F.exists(F.slice("p", 1, 5), lambda x: x == ""))
    return df.select("rule_idx", *[F.col("p")[i].alias(c) for i, c in enumerate(RULE_COLUMNS)])


def read_lightpaths(spark: SparkSession, path: str) -> DataFrame:
    """Hops of one path per line: path_id, pos, n, board, node, kind, role.

    Files are read in splits; paths are numbered from 0 by file, split and place in it, over range partitions.
    """
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), at.alias("at")).filter(F.trim("line") != "")
    lines = ranked(lines, F.col("at")).select((F.col("k") - 1).cast("int").alias("path_id"), "line")
    tokens = F.filter(F.transform(F.split("line", ","), lambda x: F.trim(x)), lambda x: x != "")
    df = lines.select("path_id", tokens.alias("x")).select("path_id", F.size("x").alias("n"), F.posexplode("x").alias("pos", "token"))
    board, role = S.split_role(F.col("token"))
    df = df.select("path_id", (F.col("pos") + 1).alias("pos"), "n", S.normalize_board_id(board).alias("board"), role.alias("role"))
    parsed = S.parse_board(F.col("board"))
    return df.select("path_id", "pos", "n", "board", parsed["node"].alias("node"), parsed["kind"].alias("kind"), "role")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    df = resolve_columns(spark.read.option("header", True).csv(path))
    return df.select("board", "event", "severity", S.parse_time(F.col("time")).alias("time"), F.col("duration_ms").try_cast("double").alias("duration_ms"), S.normalize_role(F.coalesce("role", F.lit(""))).alias("role")).filter("board is not null")


def read_node_metrics(spark: SparkSession, root: str) -> DataFrame:
    df = spark.read.schema(METRIC_SCHEMA).option("header", True).csv(f"{root}/Node_*/timeseries_*.csv")
    return df.withColumn("node", F.regexp_extract(F.col("_metadata.file_path"), r"Node_([^/]+)/", 1))


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Model outputs; malformed lines keep their text in ``_corrupt``."""
    return spark.read.schema(OUTPUT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_result_tree(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All ``*/name`` CSV files under ``root`` with the experiment's directory."""
    df = spark.read.option("header", True).csv(f"{root}/*/{name}")
    return df.withColumn("experiment", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_confusion_wide(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    first, *labels = df.columns
    return df.withColumnRenamed(first, "truth").unpivot("truth", labels, "pred", "n").withColumn("n", F.col("n").try_cast("long"))


def read_corpus(spark: SparkSession, root: str, extension: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").text(root, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_pair_scores(spark: SparkSession, path: str) -> DataFrame:
    """``(a, b): score`` entries of a text file, one row each."""
    found = F.regexp_extract_all("value", F.lit(r"\('([^']+)', *'([^']+)'\): *([0-9.]+)"), F.lit(0))
    df = spark.read.text(path).select(F.explode(found).alias("x"))
    part = lambda i: F.regexp_extract("x", r"\('([^']+)', *'([^']+)'\): *([0-9.]+)", i)
    return df.select(part(1).alias("a"), part(2).alias("b"), part(3).cast("double").alias("score"))


def write_ow_dataset(metrics: DataFrame, alarms: DataFrame, labels: DataFrame, root: str) -> None:
    """Observation windows: metrics by domain, alarms nested per window, labels beside them."""
    metrics.write.mode("append").option("maxRecordsPerFile", 5_000_000).partitionBy("domain_id").parquet(f"{root}/ow_metrics")
    columns = [c for c in alarms.columns if c != "ow_id"]
    alarms.groupBy("ow_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("alarms")).write.mode("append").json(f"{root}/ow_alarms")
    labels.write.mode("append").json(f"{root}/ow_labels")


def read_ow_dataset(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The parts of a written dataset; a filter on ``domain_id`` prunes directories, one on ``ow_id`` is pushed down."""
    return {"metrics": spark.read.parquet(f"{root}/ow_metrics"), "alarms": spark.read.json(f"{root}/ow_alarms"), "labels": spark.read.json(f"{root}/ow_labels")}


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").partitionBy("model_name").parquet(path)


def graph_tables(boards: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (nodes and boards) and edges (containment and fibres) of the topology graph."""
    v = boards.select(F.col("board").cast("string").alias("id"), F.lit("board").alias("type")).unionByName(boards.select(F.concat(F.lit("n"), F.col("node").cast("string")).alias("id"), F.lit("node").alias("type")).distinct())
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("fibre").alias("type"))
    return v, e.unionByName(boards.select(F.concat(F.lit("n"), F.col("node").cast("string")).alias("src"), F.col("board").cast("string").alias("dst"), F.lit("contains").alias("type")))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Continuous ids along ``order`` for a catalogue, over range partitions."""
    return ranked(df, *map(F.col, order)).withColumnRenamed("k", "id").drop("n")


def from_json_fields(df: DataFrame, column: str, schema: str | T.DataType) -> DataFrame:
    return df.withColumn(column, F.from_json(column, schema))
