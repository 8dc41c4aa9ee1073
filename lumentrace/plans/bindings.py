"""The domain's tables as views of the driver's star schema, in Spark and, as CTEs, in SQL.

Suppliers are boards, nations nodes, regions domains; an order's lines are a lightpath; a user's events are the
metric series and alarms of the board of that number.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S

KINDS = ("TRIB", "XCON", "LINE", "OM", "OA", "FIU", "OD", "REGENIN", "REGENOUT")

#: Fixed values: (function type, alarm, action, target type, output alarm), one per rule.
RULES = (
    ("OTUk-Relay", "Fiber_Cut", "Report Locally", "OTUk-Relay", "R_LOS"),
    ("OTUk-Relay", "Fiber_Cut", "Transmit Downstream", "ODUk-Termination", "ODUk_PM_AIS"),
    ("OTUk-Relay", "Fiber_Cut", "Transmit Upstream", "OTUk-Relay", "OTUk_BDI"),
    ("ODUk-Creation", "Line_Disconnect", "Report Locally", "ODUk-Creation", "R_LOS"),
    ("ODUk-Creation", "Line_Disconnect", "Transmit Downstream", "ODUk-Termination", "ODUk_PM_AIS"),
    ("ODUk-Creation", "Line_Disconnect", "Transmit Upstream", "ODUk-Creation", "OTUk_BDI"),
    ("ODUk-Termination", "ODUk_PM_AIS", "Report Locally", "ODUk-Termination", "ODUk_PM_AIS"),
    ("ODUk-Termination", "ODUk_PM_AIS", "Transmit Upstream", "ODUk-Creation", "ODUk_PM_BDI"),
    ("ODUk-Creation", "ODUk_PM_BDI", "Report Locally", "ODUk-Creation", "ODUk_PM_BDI"),
    ("ODUk-Creation", "ODUk_PM_BDI", "Transmit Downstream", "ODUk-Termination", "ODUk_PM_AIS"),
    ("OTUk-RegenIn", "Fiber_Cut", "Transmit Downstream RegenOut", "OTUk-RegenOut", "OTUk_AIS"),
    ("OTUk-RegenOut", "OTUk_AIS", "Transmit Downstream", "ODUk-Termination", "ODUk_PM_AIS"),
    ("OTUk-RegenOut", "Fiber_Cut", "Report Locally", "OTUk-RegenOut", "R_LOS"),
)
RULE_COLUMNS = ("rule_idx", "from_type", "from_alarm", "action", "to_type", "to_alarm")
RULE_SCHEMA = "rule_idx int, from_type string, from_alarm string, action string, to_type string, to_alarm string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_of(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (key % len(KINDS) + 1).cast("int"))


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    df = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("board"), F.col("s_nationkey").alias("node"), F.col("n_regionkey").alias("domain"), kind_of(F.col("s_suppkey")).alias("kind")
    )
    return df.withColumn("name", S.board_name(F.col("node"), F.col("kind"), F.col("board")))


#: Boards (four columns each) up to which they are broadcast to the lines.
MAX_BOARDS = 500_000
#: Lines that one task sorts by path.
LINES_A_TASK = 250_000


def path_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Parts that bound what a task holds of the lines; none if one task's worth is all there is, where the session's number does."""
    parts = math.ceil(table(spark, sf_dir, "lineitem").count() / LINES_A_TASK)
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts > 1 else None


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, pos (from 1), n (hops of the path), board, node, kind, role (token's, may be empty).

    Boards are broadcast if their number, read from the file's footer, allows it: then lines are exchanged once, by path,
    and windows over paths need no exchange of their own. The parts of that exchange follow from the number of lines, read from the
    footer too, so that what a task sorts does not grow with them, whatever the session's number of partitions.
    """
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    if (parts := path_parts(spark, sf_dir)) is not None:
        lines = lines.repartition(parts, "l_orderkey")
    df = lines.select(
        F.col("l_orderkey").alias("path_id"),
        F.row_number().over(order).alias("pos"),
        F.count(F.lit(1)).over(W.partitionBy("l_orderkey")).cast("int").alias("n"),
        F.col("l_suppkey").alias("board"),
    )
    known = boards(spark, sf_dir).select("board", "node", "domain", "kind")
    df = df.join(F.broadcast(known) if table(spark, sf_dir, "supplier").count() <= MAX_BOARDS else known, "board")
    return df.select("path_id", "pos", "n", "board", "node", "domain", "kind", F.when(F.col("pos") == 1, "SRC").when(F.col("pos") == F.col("n"), "TERMINATION").otherwise("").alias("role"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """board, t (from 0), bbe: a user's values in order of time."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("board"), (F.row_number().over(order) - 1).alias("t"), F.col("value").alias("bbe"), F.col("ts"))


def rules(spark: SparkSession, of: tuple = RULES) -> DataFrame:
    """Rules as literal rows of the plan, which take no job to read."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(RULE_COLUMNS, (i, *r), strict=True)) for i, r in enumerate(of)]), RULE_SCHEMA)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("board"), F.col("event_type").alias("alarm"), "value")


_kind_sql = "['" + "','".join(KINDS) + "']"
_rules_sql = ", ".join("(" + ", ".join([str(i), *[f"'{v}'" for v in r]]) + ")" for i, r in enumerate(RULES))

#: CTEs by name, with the names they build on.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "boards": (
        (),
        f"""SELECT s_suppkey AS board, s_nationkey AS node, n_regionkey AS domain, {_kind_sql}[(s_suppkey % 9 + 1)::INT] AS kind,
        'ROADM' || s_nationkey || '-' || {_kind_sql}[(s_suppkey % 9 + 1)::INT] || CASE WHEN s_suppkey < 1000 THEN lpad(s_suppkey::VARCHAR, 3, '0') ELSE s_suppkey::VARCHAR END || '$0' AS name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ),
    "lines": (
        (),
        """SELECT l_orderkey AS path_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS pos,
        (count(*) OVER (PARTITION BY l_orderkey))::INT AS n, l_suppkey AS board FROM lineitem""",
    ),
    "hops": (
        ("boards", "lines"),
        """SELECT path_id, pos, n, l.board, node, domain, kind, CASE WHEN pos = 1 THEN 'SRC' WHEN pos = n THEN 'TERMINATION' ELSE '' END AS role
        FROM lines l JOIN boards b ON l.board = b.board""",
    ),
    "role_map": (("hops",), "SELECT board, arg_min(role, (path_id, pos)) AS role FROM hops WHERE role <> '' GROUP BY board"),
    "typed": (
        ("boards", "role_map"),
        """SELECT b.board, node, domain, kind, name, coalesce(role, '') AS role, CASE WHEN role = 'SRC' THEN 'ODUk-Creation' WHEN role = 'TERMINATION' THEN 'ODUk-Termination'
        WHEN kind = 'REGENIN' THEN 'OTUk-RegenIn' WHEN kind = 'REGENOUT' THEN 'OTUk-RegenOut' WHEN kind IN ('TRIB','XCON','LINE') THEN 'ODUk-Creation' ELSE 'OTUk-Relay' END AS ftype
        FROM boards b LEFT JOIN role_map r ON b.board = r.board""",
    ),
    "pairs": (
        ("hops",),
        """SELECT * FROM (SELECT path_id, pos, board AS src, kind AS src_kind, node AS src_node, lead(board) OVER w AS dst, lead(kind) OVER w AS dst_kind, lead(node) OVER w AS dst_node FROM hops
        WINDOW w AS (PARTITION BY path_id ORDER BY pos)) WHERE dst IS NOT NULL""",
    ),
    "edges": (
        ("pairs",),
        """SELECT DISTINCT src, dst, src_node, dst_node, CASE WHEN src_kind = 'REGENIN' AND dst_kind = 'REGENOUT' THEN 'regen_boundary' ELSE src_kind || '_' || dst_kind END AS edge_type FROM pairs""",
    ),
    "metrics": ((), "SELECT user_id AS board, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS t, value AS bbe, ts FROM events"),
    "rules": ((), f"SELECT * FROM (VALUES {_rules_sql}) v(rule_idx, from_type, from_alarm, action, to_type, to_alarm)"),
    "ev": ((), "SELECT event_id, ts, user_id AS board, event_type AS alarm, value FROM events"),
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` after the CTEs it names and those they build on."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in CTES[name][0]:
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    tail = body.strip()
    if tail.startswith("WITH "):
        tail, head = tail[5:], head + (", " if head else "")
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{tail}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {tail}" if head else tail
