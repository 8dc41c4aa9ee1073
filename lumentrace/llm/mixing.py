"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Targets share the size of everything by weight; none exceeds
``cap`` times its source's size, what is above goes to the others by weight. Within a source every document
expects target / source size copies; these are summed along an order by size, one random offset per source
is added, and a document is emitted once per whole number that its own stretch crosses.

The running sum needs no sort of a whole source: documents fall into buckets by size and these into salted
groups of bounded size, the counts of groups are summed along the order, and only the rank inside a group
is found by a window. A source with a third of all rows is spread over many groups.

Defined results: a null text has size 0; null is a source of its own, last in order; repeated rows are
sampled each; ties in size and id are equal rows whose order does not matter; no rows give no rows; other
columns pass through ``mix`` whatever their names, and through ``sample`` unless named as one of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import aside, restored, words

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents for which one more salt is used: bounds a group whatever the table's size.
PER_SALT = 5_000
#: Names of the columns that ``sample`` adds or works with, after ``_lt_``.
OWN = ("size", "source_size", "target", "copies", "s", "null", "salt", "bucket", "n", "before", "inner", "rank", "w", "ratio", "level")


def unit(c: Column) -> Column:
    """A number in [0, 1) from a string, equal in every run and engine."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per source (``_lt_s``, ``_lt_null``): its size and its target. One row per source, so windows over all are small."""
    per = sizes.groupBy("_lt_s", "_lt_null").agg(F.sum("_lt_size").alias("_lt_source_size"))
    rank = F.row_number().over(W.orderBy("_lt_null", "_lt_s")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("_lt_w", weight).withColumn("_lt_ratio", F.col("_lt_source_size") * float(cap) / F.col("_lt_w"))
    order = W.orderBy("_lt_ratio", "_lt_null", "_lt_s")
    before, after, every = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # If this source is the first below its cap, all before it are at theirs and the rest is shared from here on.
    level = (F.sum("_lt_source_size").over(every) - F.coalesce(F.sum(F.col("_lt_source_size") * cap).over(before), F.lit(0))) / F.sum("_lt_w").over(after)
    per = per.withColumn("_lt_level", level)
    per = per.withColumn("_lt_level", F.min(F.when(F.col("_lt_level") <= F.col("_lt_ratio"), F.struct("_lt_ratio", "_lt_level"))).over(every)["_lt_level"])
    return per.select("_lt_s", "_lt_null", "_lt_source_size", F.least(F.col("_lt_source_size") * float(cap), F.col("_lt_level") * F.col("_lt_w")).alias("_lt_target"))


def sample(docs: DataFrame, source_col="source", text_col="text", id_col="doc_id", weights=WEIGHTS, cap: float = CAP, seed: int = 11) -> DataFrame:
    """``docs`` with ``_lt_size``, ``_lt_source_size``, ``_lt_target`` and ``_lt_copies``; given columns of these or the other names
    that this function works with are not returned."""
    docs = docs.drop(*(f"_lt_{n}" for n in OWN))
    salts = max(1, -(-docs.count() // PER_SALT))
    keys = ["_lt_s", "_lt_null", "_lt_bucket", "_lt_salt"]
    df = docs.withColumns(
        {
            "_lt_size": F.size(words(F.col(text_col))).cast("long"),
            "_lt_s": F.coalesce(F.col(source_col), F.lit("")),
            "_lt_null": F.col(source_col).isNull(),
            "_lt_salt": F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % salts, F.lit(0)),
        }
    )
    df = df.withColumn("_lt_bucket", F.floor(F.sqrt("_lt_size")))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lt_n"), F.sum("_lt_size").alias("_lt_size"))
    source, bucket = keys[:2], keys[:3]
    running = lambda by, order: F.coalesce(F.sum("_lt_n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = groups.groupBy(*bucket).agg(F.sum("_lt_n").alias("_lt_n"))
    buckets = buckets.select(*bucket, running(source, "_lt_bucket").alias("_lt_before"))
    places = groups.withColumn("_lt_inner", running(bucket, "_lt_salt")).drop("_lt_n", "_lt_size")
    aims = targets(groups, weights, cap)
    places = places.join(buckets, bucket).join(aims, source).withColumn("_lt_before", F.col("_lt_before") + F.col("_lt_inner")).drop("_lt_inner")
    ranked = df.withColumn("_lt_rank", F.row_number().over(W.partitionBy(*keys).orderBy("_lt_size", id_col)))
    out = ranked.join(places, keys)
    each = F.when(F.col("_lt_source_size") > 0, F.col("_lt_target") / F.col("_lt_source_size")).otherwise(0.0)
    offset = unit(F.concat(F.lit(f"{seed} "), F.col("_lt_null").cast("string"), F.lit(" "), F.col("_lt_s")))
    rank = F.col("_lt_before") + F.col("_lt_rank")
    copies = F.floor(offset + rank * each) - F.floor(offset + (rank - 1) * each)
    out = out.withColumn("_lt_copies", F.least(copies, F.lit(int(cap))).cast("long"))
    return out.select(*docs.columns, "_lt_size", "_lt_source_size", "_lt_target", "_lt_copies")


def mix(docs: DataFrame, source_col="source", text_col="text", id_col="doc_id", **options) -> DataFrame:
    """``docs``, every row as often as it is taken."""
    rows = aside(docs, source=F.col(source_col), text=F.col(text_col), doc_id=F.col(id_col))
    out = sample(rows, **options).filter(F.col("_lt_copies") > 0)
    return restored(out.withColumn("_lt_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_lt_copies"))), docs.columns)
