"""Rule files: canonical and normalised forms, compact and merged ones, and rules as sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edge types by the types they join, and the types whose case is kept.
EDGES = {
    ("Tributary", "XCON"): "Tributary_XCON",
    ("XCON", "Line"): "XCON_Line",
    ("Line", "OM"): "Line_OM",
    ("OM", "OA"): "OM_OA",
    ("OA", "OD"): "OA_OD",
    ("OD", "Line"): "OD_Line",
    ("FIU", "OA"): "FIU_OA",
    ("SC2", "FIU"): "SC2_FIU",
    ("RegenIn", "RegenOut"): "regen_boundary",
}
KEPT_CASE = ("OTUk-RegenIn", "OTUk-RegenOut", "OTUk-Relay", "ODUk-Creation", "ODUk-Termination")
#: Types that stand for several; an edge from one of them is named by its end.
WIDE = ("Electrical", "Optical", "Any")
WIDE_EDGES = {"Xcon": "XCON_Line", "Om": "Line_OM", "Tributary": "Tributary_XCON"}


def _lower(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def canonical(rules: DataFrame) -> DataFrame:
    """Function rules (function_type, event, action, target, output) as board-type rules with edge type and note; unknown edge types are null."""
    fn, action, target = _lower("function_type"), _lower("action"), _lower("target")
    source = F.when(fn.contains("otuk"), "Line").when(fn.contains("oduk") & fn.contains("relay"), "XCON").otherwise("Tributary")
    optical = target.contains("opt") | target.contains("om")
    down = F.when(F.col("from_type") == "Tributary", "XCON").otherwise(F.when(optical, "OM").otherwise("Line"))
    goal = (
        F.when(action.contains("report") & action.contains("local"), F.col("from_type"))
        .when(action.contains("upstream"), F.when(F.col("from_type") == "Line", "XCON").otherwise("Tributary"))
        .when(action.contains("downstream"), down)
        .when(optical, "OM")
        .when(target.contains("od"), "OD")
        .otherwise(F.col("from_type"))
    )
    pair = lambda a, b: (F.col("from_type") == a) & (F.col("to_type") == b)
    edge = F.coalesce(*[F.when(pair(a, b), f"{a}_{b}") for a, b in (("Tributary", "XCON"), ("XCON", "Line"), ("Line", "OM"), ("OD", "Line"))], F.when(optical, "Line_OM"))
    event, output = F.nullif(F.col("event"), F.lit("")), F.nullif(F.col("output"), F.lit(""))
    note = F.concat_ws(" / ", F.coalesce("function_type", F.lit("")), F.coalesce("action", F.lit("")), F.coalesce("target", F.lit("")))
    df = rules.withColumn("from_type", source).withColumn("to_type", goal)
    return df.select(
        "rule_idx", "from_type", F.coalesce(event, F.lit("ANY")).alias("from_alarm"), "to_type", F.coalesce(output, event, F.lit("ANY")).alias("to_alarm"), edge.alias("edge_type"), F.regexp_replace(note, r"^[ /]+|[ /]+$", "").alias("note")
    )


def typed_case(name: Column) -> Column:
    """Known function types in their own case, others with a capital at the start of each word."""
    plain = F.trim(name)
    return F.coalesce(*[F.when(F.lower(plain) == k.lower(), k) for k in KEPT_CASE], F.initcap(plain))


def normalised(rules: DataFrame) -> DataFrame:
    """Rules (from_type, from_alarm, to_type, to_alarm, and edge_type, delay_ms, severity that may be null) with all gaps filled.

    A missing edge type comes from the fixed pairs of types, else from the two names; delay is 500 ms and severity Major by default.
    """
    a, b = typed_case(F.col("from_type")), typed_case(F.col("to_type"))
    named = F.coalesce(*[F.when((F.col("_a") == x) & (F.col("_b") == y), e) for (x, y), e in EDGES.items()], F.concat(F.col("_a"), F.lit("_"), F.col("_b")))
    wide = F.when(F.col("_a").isin(*WIDE), F.coalesce(*[F.when(F.col("_b") == k, v) for k, v in WIDE_EDGES.items()]))
    severity = F.initcap(F.trim("severity"))
    df = rules.withColumns({"_a": a, "_b": b})
    return df.select(
        "rule_idx", F.col("_a").alias("from_type"), F.trim("from_alarm").alias("from_alarm"), F.col("_b").alias("to_type"), F.trim("to_alarm").alias("to_alarm"),
        F.coalesce(F.trim("edge_type"), wide, named).alias("edge_type"), F.coalesce(F.col("delay_ms").try_cast("double").cast("int"), F.lit(500)).alias("delay_ms"), F.coalesce(F.nullif(severity, F.lit("")), F.lit("Major")).alias("severity"),
    )


def compact(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines of a rule file without blanks, comments and rules of regenerators."""
    x = F.trim(column)
    return lines.filter((x != "") & ~x.startswith("#") & ~x.contains("RegenIn") & ~x.contains("RegenOut")).withColumn(column, x)


def merged(*tables: DataFrame, legacy: str = "OTU") -> DataFrame:
    """Rule rows (board, event, output_board, output_type, output) of all tables, once each, without legacy boards."""
    rows = reduce(DataFrame.unionByName, tables)
    old = F.coalesce(F.col("board"), F.lit("")).contains(legacy) | F.coalesce(F.col("output_board"), F.lit("")).contains(legacy)
    return rows.filter(~old).dropDuplicates(["board", "event", "output_board", "output_type", "output"])


def one_output_a_row(rules: DataFrame) -> DataFrame:
    """Outputs that stand side by side, parted by semicolons, as rows of their own."""
    parts = F.arrays_zip(*[F.split(c, ";").alias(c) for c in ("output_board", "output_type", "output")])
    return rules.select("board", "event", F.posexplode(parts).alias("n", "o")).select("board", "event", "n", "o.output_board", "o.output_type", "o.output")


def sentence(function_type: Column, event: Column, action: Column, target: Column, output: Column) -> Column:
    """``type event -> output (action to target)``."""
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    how = F.when(plain(action) == "", "").otherwise(F.concat(F.lit(" ("), plain(action), F.when(plain(target) == "", "").otherwise(F.concat(F.lit(" to "), plain(target))), F.lit(")")))
    return F.concat(plain(function_type), F.lit(" "), plain(event), F.lit(" -> "), plain(output), how)
