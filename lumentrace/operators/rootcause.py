"""Root-cause rules over a board's features, and retrieval of similar cases and texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S
from lumentrace.sources.storage import materialise

from .preparation import ranked

#: Reference peak of each event, in ascending order.
PEAKS = ((28.0, "Fiber_Aging"), (32.0, "XCON_Port_Down"), (36.0, "Line_Disconnect"), (42.0, "Fiber_Crack"), (46.0, "XCON_Buffer_Overflow"), (50.4, "XCON_Fabric_Fault"), (55.0, "Fiber_Cut"))
#: Category and pattern to event; Line boards always disconnect.
BY_PATTERN = {
    ("Fiber", "ramp"): "Fiber_Aging",
    ("Fiber", "step"): "Fiber_Cut",
    ("Fiber", "step_recovery"): "Fiber_Crack",
    ("Fiber", "burst"): "Fiber_Aging",
    ("XCON", "step"): "XCON_Port_Down",
    ("XCON", "burst"): "XCON_Buffer_Overflow",
    ("XCON", "step_recovery"): "XCON_Fabric_Fault",
    ("XCON", "ramp"): "XCON_Port_Down",
    ("Line", "step"): "Line_Disconnect",
    ("Line", "step_recovery"): "Line_Disconnect",
    ("Line", "ramp"): "Line_Disconnect",
    ("Line", "burst"): "Line_Disconnect",
}
DEFAULT = {"Fiber": "Fiber_Cut", "XCON": "XCON_Port_Down", "Line": "Line_Disconnect"}


def nearest_event(peak: Column, category: Column | None = None) -> Column:
    """Event with the closest reference peak, of the category if given; the first of equals; null for peaks of 0 or less."""
    options = F.array(*[F.struct(F.abs(peak - p).alias("d"), F.lit(i).alias("i"), F.lit(e).alias("e"), F.lit(S.EVENT_CATEGORY[e]).alias("c")) for i, (p, e) in enumerate(PEAKS)])
    if category is not None:
        options = F.filter(options, lambda x: x["c"] == category)
    return F.when(peak > 0, F.array_min(options)["e"])


def pattern_event(category: Column, pattern: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (c, p), e in BY_PATTERN.items() for x in (f"{c}/{p}", e)])
    return F.element_at(table, F.concat(category, F.lit("/"), pattern))


def root_cause(category: Column, pattern: Column, peak: Column) -> Column:
    """Pattern first; else the nearest peak within the board's category; else the category's default."""
    default = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEFAULT.items() for x in kv]), category), F.lit("unknown"))
    return F.coalesce(pattern_event(category, pattern), nearest_event(peak, category), default)


#: Vectors and queries in a block, queries taken at once, and how far sums of another order and rounding to 9 digits can part two scores.
BLOCK, SLICE, NEAR = 8_192, 256, 2e-9


#: Width of a unit of peaks, as a share of the span: peaks that a whole unit parts have scores that rounding to 9 digits keeps apart.
UNIT = 1e-8


def _levelled(df: DataFrame, pattern: str, kind: str, peak: str) -> DataFrame:
    """Rows once for each level at which they can meet others: 0 anyone, 1 of their pattern, 2 of their kind, 3 of both."""
    x = df.withColumn("level", F.explode(F.array(*map(F.lit, range(4)))))
    by_pattern, by_kind = F.col("level").isin(1, 3), F.col("level").isin(2, 3)
    x = x.filter((~by_pattern | F.col(pattern).isNotNull()) & (~by_kind | F.col(kind).isNotNull()))
    none = F.lit("")
    return x.withColumns({"p": F.when(by_pattern, F.col(pattern).cast("string")).otherwise(none), "k": F.when(by_kind, F.col(kind).cast("string")).otherwise(none), "unit": F.rint(F.col(peak).cast("double") / F.lit(UNIT))})


def near_cases(cases: DataFrame, asked: DataFrame, span: float, top: int) -> DataFrame:
    """Scored pairs (kind, pattern, peak, case_id, score) of each distinct question that hold its ``top + 1`` best cases.

    Among the cases that agree with a question in the same ways, nearness of the peak decides. So at each level only the cases of the
    ``top + 2`` nearest units of peaks on either side can be among the best, and of equal peaks those with the smallest ids. The units of cases
    are numbered along a sorted order, in which a question's units have their place, and a question meets the numbers around its own:
    pairs grow with the questions, however many peaks are alike.
    """
    group, m, scaled = ["level", "p", "k"], top + 1, lambda c: F.col(c) / F.lit(float(span))
    c = _levelled(cases.withColumn("s", scaled("c_peak")), "c_pattern", "c_kind", "s").drop("s")
    few = W.partitionBy(*group, "unit", "c_peak").orderBy("case_id")
    members = materialise(c.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= m).drop("n"), "case-units")
    cells = _levelled(asked.select("kind", "pattern", "peak").distinct().withColumn("s", scaled("peak")), "pattern", "kind", "s").drop("s")
    cells = materialise(cells, "question-units")
    units = lambda df, case: df.select(*group, "unit", F.lit(case).alias("case"), F.lit(1 - case).alias("question")).distinct()
    both = units(members, 1).unionByName(units(cells, 0)).groupBy(*group, "unit").agg(F.max("case").alias("case"), F.max("question").alias("question"))
    placed = materialise(ranked(both, *map(F.col, [*group, "unit"]), of="case", name="at"), "placed-units")
    there = placed.filter("case = 1").select(*group, F.col("unit").alias("c_unit"), "at")
    around = placed.filter("question = 1").select(*group, "unit", F.explode(F.sequence(F.col("at") - m, F.col("at") + m + 1)).alias("at"))
    near = around.join(there, ["at", *group]).drop("at").filter(F.abs(F.col("unit") - F.col("c_unit")) * F.lit(UNIT) <= 1 + 4 * UNIT)
    j = cells.join(near, [*group, "unit"]).drop("unit").join(members.withColumnRenamed("unit", "c_unit"), [*group, "c_unit"])
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    # Pairs that agree in more than their level asks for are met at their own.
    j = j.filter((same("pattern", "c_pattern") == F.col("level").isin(1, 3)) & (same("kind", "c_kind") == F.col("level").isin(2, 3)) & (F.abs(F.col("peak") - F.col("c_peak")) <= span))
    score = F.when(F.col("pattern") == F.col("c_pattern"), 0.4).otherwise(0.0) + F.when(F.col("kind") == F.col("c_kind"), 0.3).otherwise(0.0) + 0.3 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("peak") - F.col("c_peak")) / span)
    return j.select("kind", "pattern", "peak", "case_id", F.round(score, 9).alias("score"))


def similar_cases(cases: DataFrame, asked: DataFrame, span: float, top: int) -> DataFrame:
    """Best cases (case_id, kind, pattern, peak) of each question (q_id, kind, pattern, peak) by pattern, kind and peak, itself left out.

    Questions alike in all three are answered once, with one case more than asked for, and take that answer without themselves.
    """
    finite = F.abs(F.col("peak").cast("double")) < float("inf")
    c = cases.filter(finite & F.col("case_id").isNotNull()).select("case_id", F.col("kind").alias("c_kind"), F.col("pattern").alias("c_pattern"), F.col("peak").alias("c_peak"))
    q = asked.filter(finite & F.col("q_id").isNotNull()).select("q_id", "kind", "pattern", "peak")
    w = W.partitionBy("kind", "pattern", "peak").orderBy(F.desc("score"), "case_id")
    best = near_cases(c, q, span, top).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top + 1).drop("rank")
    a, b = q.alias("a"), best.alias("b")
    alike = F.col("a.kind").eqNullSafe(F.col("b.kind")) & F.col("a.pattern").eqNullSafe(F.col("b.pattern")) & (F.col("a.peak") == F.col("b.peak"))
    j = a.join(b, alike).filter("case_id <> q_id").select("q_id", "case_id", "score")
    w = W.partitionBy("q_id").orderBy(F.desc("score"), "case_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("q_id", "rank", "case_id", "score")


def chunk_text(texts: DataFrame, id_col: str, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters every ``size - overlap``; blank ones dropped."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    df = texts.filter(F.length("text") > 0).select(id_col, "text", F.posexplode(starts).alias("chunk", "at"))
    part = F.substring("text", F.col("at") + 1, F.lit(size))
    return df.select(id_col, "chunk", part.alias("part")).filter(F.trim(F.regexp_replace("part", r"[\x09-\x0D]", " ")) != "")


def topk_inner_product(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Exact search of a stated set of queries against all rows; scores are cosines, rounded to 9 digits.

    Vectors and queries are dealt to blocks, every two of which meet in a task of their own. There a matrix product finds
    what can be among a block's best: it lets through all that lies within ``NEAR`` of the last place, as its sums may differ in
    their last bits. Their scores are summed anew in the order of the components, and the best of all blocks are ranked. Vectors
    that are null, of another length than the longest, or hold null or non-finite components meet the rest in a plain join.
    """
    unit = lambda v: F.transform(v, lambda x: x.cast("double") / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    blocks, q_blocks = max(1, -(-size["n"] // BLOCK)), max(1, -(-queries.count() // BLOCK))
    sound = F.coalesce((F.size("embedding") == (size["d"] or 0)) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    n = lambda cond, *cols: vectors.filter(F.col("vec_id").isNotNull() & cond).select("vec_id", unit(F.col("embedding")).alias("v"), *cols)
    q = lambda cond, *cols: queries.filter(F.col("vec_id").isNotNull() & cond).select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("qv"), *cols)
    dealt = lambda k, name: F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int").alias(name)
    each = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    at = ["block", "q_block"]
    asked = q(sound, each(blocks, "block"), dealt(q_blocks, "q_block")).groupBy(*at)
    met = asked.cogroup(n(sound, dealt(blocks, "block"), each(q_blocks, "q_block")).groupBy(*at)).applyInPandas(lambda a, b: block_best(a, b, top), "query_id long, vec_id long, score double")

    # A null score is one as well, the last of all.
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    odd = n(~sound, each(q_blocks, "part")).join(q(F.lit(True), dealt(q_blocks, "part")), "part").unionByName(n(sound, dealt(blocks, "part")).join(q(~sound, each(blocks, "part")), "part"))
    odd = odd.filter("vec_id <> query_id").select("query_id", "vec_id", dot.alias("score"))
    j = met.unionByName(odd).withColumn("score", F.round("score", 9))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def block_best(queries: pd.DataFrame, vectors: pd.DataFrame, top: int) -> pd.DataFrame:
    """Of each query the vectors of one block that can be among its ``top`` by rounded score, with scores summed component by component."""
    empty = pd.DataFrame({"query_id": np.empty(0, "int64"), "vec_id": np.empty(0, "int64"), "score": np.empty(0)})
    if queries.empty or vectors.empty:
        return empty
    vectors = vectors.sort_values("vec_id")
    ids, m = vectors["vec_id"].to_numpy(), np.stack(vectors["v"].to_numpy())
    out = [empty]
    for at in range(0, len(queries), SLICE):
        some = queries.iloc[at : at + SLICE]
        q_ids, qm = some["query_id"].to_numpy(), np.stack(some["qv"].to_numpy())
        s = qm @ m.T
        s[q_ids[:, None] == ids[None, :]] = -np.inf
        last = np.partition(s, -top, axis=1)[:, -top] if s.shape[1] > top else np.full(len(s), -np.inf)
        i, k = np.nonzero((s >= last[:, None] - NEAR) & (s > -np.inf))
        score = np.zeros(len(i))
        for d in range(m.shape[1]):
            score += m[k, d] * qm[i, d]
        # Of equal scores, as copies have them, the first ids are enough.
        found = pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[k], "score": score})
        found = found.sort_values(["query_id", "score", "vec_id"], kind="stable")
        out.append(found[found.groupby(["query_id", "score"]).cumcount() < top])
    return pd.concat(out)
