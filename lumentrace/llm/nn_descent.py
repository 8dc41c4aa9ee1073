"""Approximate nearest neighbours: NN-descent builds the graph, greedy search answers queries.

Equal vectors are one node. A first graph comes from leaves of random-hyperplane trees and from groups drawn by
hash, so that a node alone in its leaves has edges too; then rounds of joins bring
the neighbours of a node together (forward and backward edges), compare them with each other where one of the two
is new, and keep each node's ``k`` best. Queries walk the graph from their own node and a few drawn ones: the nearest nodes not yet looked at are expanded,
round by round, until none of the ``beam`` nearest is left to expand. A query that still lacks rows is compared with
all nodes, in blocks. Distances in the graph are computed on
single-precision copies with an exponent each, which keeps shuffles small and leaves vectors of any magnitude their
digits; the scores returned are computed on the original vectors in double precision.

Leaves and the edge lists of hubs are split into blocks of bounded size, so no task holds an unbounded group;
what reaches the driver are ``2 * trees * depth`` vectors for the hyperplanes (depth is the logarithm of the
number of nodes over ``leaf``).

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
vectors of another length than the most common one (the larger of equally common ones counts); equal vectors tie and
the smaller id comes first; repeated ids are rows of their own; too few vectors give all there are; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise


@dataclass(frozen=True)
class Descent:
    #: Neighbours a node.
    k: int = 32
    leaf: int = 128
    trees: int = 4
    rounds: int = 5
    #: Share of edges that must still change for another round.
    least_change: float = 0.01
    #: Edges of a node that are compared with each other at once.
    block: int = 160
    #: Better partners that one block may name for a node.
    emit: int = 10
    beam: int = 192
    #: Nodes expanded for a query in one round.
    width: int = 32
    #: Drawn nodes from which every walk starts too.
    entries: int = 16


def _valid(v: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part."""
    df = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(_valid(F.col("v")))
    sizes = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return df.filter(F.size("v") == (sizes["n"] if sizes else 0))


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    """Binary or list column as a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _packed(m: np.ndarray) -> np.ndarray:
    """Rows as a binary exponent and single-precision digits."""
    power = np.frexp(np.abs(m).max(axis=1))[1].astype("<i4")[:, None]
    return np.hstack([power.view("<f4"), np.ldexp(m, -power).astype("<f4")])


def _unpacked(column: pa.Array) -> np.ndarray:
    raw = _rows(column, "<f4")
    return np.ldexp(raw[:, 1:].astype("f8"), raw[:, :1].copy().view("<i4"))


def nodes_of(rows: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node``, ``v`` as doubles, ``h`` packed for the graph) and their members (``node``, ``vec_id``), the ``copies`` smallest ids of each."""
    same = W.partitionBy("v")
    some = rows.withColumn("place", F.row_number().over(same.orderBy("vec_id"))).filter(F.col("place") <= copies)
    some = materialise(some.withColumn("node", F.min("vec_id").over(same)), "vectors")
    largest = some.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    # A power of two keeps squares finite; the middle of a few nodes as origin saves the digits of vectors far from zero.
    power = 490 - int(np.frexp(float(largest or 1.0))[1])
    firsts = some.filter("place = 1")
    few = [r["v"] for r in firsts.orderBy(F.xxhash64("node"), "node").limit(101).select("v").collect()]
    middle = np.median(np.ldexp(np.array(few, "f8"), power), axis=0) if few else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                m = _rows(batch.column(1), "").astype("<f8")
                packed = _packed(np.ldexp(m, power) - middle)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary()), pa.array([x.tobytes() for x in packed], pa.binary())], ["node", "v", "h"])

    nodes = firsts.select("node", "v").mapInArrow(run, "node long, v binary, h binary")
    return materialise(nodes, "nodes"), some.select("node", "vec_id")


def _best_edges(edges: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("node").orderBy("dist", "nbr")
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _distances(m: np.ndarray) -> np.ndarray:
    norms = (m * m).sum(axis=1)
    d = norms[:, None] + norms[None, :] - 2 * (m @ m.T)
    np.fill_diagonal(d, np.inf)
    return np.maximum(d, 0, out=d)


EDGE = "node long, nbr long, dist double"


def _edge_batch(a: list, b: list, d: list) -> pa.RecordBatch:
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(cat(a, np.int64)), pa.array(cat(b, np.int64)), pa.array(cat(d, np.float64))], ["node", "nbr", "dist"])


def first_graph(nodes: DataFrame, how: Descent) -> DataFrame:
    """Each node's best partners in the leaves it falls into."""
    count = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, count) / how.leaf)))
    ends = [_unpacked(pa.array([r["h"]]))[0] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(2 * how.trees * depth).select("h").collect()]
    planes = np.array([a - b for a, b in zip(ends[::2], ends[1::2], strict=False)]).reshape(-1, len(ends[0]) if ends else 1)
    shifts = np.array([((a + b) / 2) @ (a - b) for a, b in zip(ends[::2], ends[1::2], strict=False)])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bits = (_unpacked(batch.column(1)) @ planes.T > shifts).astype(np.int64) if depth else np.zeros((len(batch), 0), np.int64)
            for t in range(how.trees if depth else 1):
                own = bits[:, t * depth : (t + 1) * depth]
                code = (own << np.arange(own.shape[1])).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), t, np.int32)), pa.array(code.astype(np.int64))], ["node", "tree", "code"])

    placed = nodes.select("node", "h").mapInArrow(codes, "node long, tree int, code long")
    mates = max(how.leaf, 2 * how.k)
    if depth:
        # Whoever the hyperplanes leave alone meets others here, in groups of about ``mates``.
        groups = max(1, count // mates)
        drawn = F.pmod(F.xxhash64("node", F.lit(how.trees)), F.lit(groups))
        placed = placed.unionByName(nodes.select("node", F.lit(how.trees).cast("int").alias("tree"), drawn.cast("long").alias("code")))
    placed = materialise(placed, "leaves")
    sizes = placed.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("n"))
    room = F.when(F.col("tree") < how.trees, 2 * how.leaf).otherwise(2 * mates)
    spread = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / room))
    leaves = placed.join(sizes, ["tree", "code"]).withColumn("part", spread).join(nodes.select("node", "h"), "node")
    leaves = leaves.groupBy("tree", "code", "part").agg(F.collect_list(F.struct("node", "h")).alias("m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, d = [], [], []
            for i in range(len(batch)):
                flat = batch.column(0).slice(i, 1).flatten()
                ids, m = flat.field("node").to_numpy(), _unpacked(flat.field("h"))
                dist = _distances(m)
                k = min(how.k, len(ids) - 1)
                if k > 0:
                    best = np.argpartition(dist, k - 1, axis=1)[:, :k]
                    a.append(np.repeat(ids, k))
                    b.append(ids[best].ravel())
                    d.append(np.take_along_axis(dist, best, 1).ravel())
            yield _edge_batch(a, b, d)

    return leaves.select("m").mapInArrow(compare, EDGE).groupBy("node", "nbr").agg(F.min("dist").alias("dist"))


def descend(graph: DataFrame, nodes: DataFrame, how: Descent, turn: int) -> DataFrame:
    """One round: neighbours of every node are compared with each other, a hub's in blocks that each ``turn`` deals anew."""
    worst = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= how.k, F.max("dist")).otherwise(float("inf")).alias("worst"))
    both = graph.select("node", "nbr", "fresh").unionByName(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "fresh"))
    around = both.groupBy("node", "nbr").agg(F.max("fresh").alias("fresh"))
    degree = around.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any")).filter("any")
    about = nodes.select(F.col("node").alias("nbr"), "h").join(worst.withColumnRenamed("node", "nbr"), "nbr", "left")
    lists = (
        around.join(degree, "node")
        .withColumn("part", F.pmod(F.xxhash64("nbr", F.lit(turn)), F.ceil(F.col("n") / how.block)))
        # Two old edges of a hub may meet in a block for the first time.
        .withColumn("fresh", F.col("fresh") | (F.col("n") > how.block))
        .join(about, "nbr")
        .groupBy("node", "part")
        .agg(F.collect_list(F.struct("nbr", "fresh", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "h")).alias("m"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, d = [], [], []
            for i in range(len(batch)):
                flat = batch.column(0).slice(i, 1).flatten()
                ids, fresh = flat.field("nbr").to_numpy(), flat.field("fresh").to_numpy(zero_copy_only=False)
                if len(ids) < 2 or not fresh.any():
                    continue
                dist = _distances(_unpacked(flat.field("h")))
                dist[~(fresh[:, None] | fresh[None, :])] = np.inf
                dist[dist >= flat.field("worst").to_numpy()[:, None]] = np.inf
                k = min(how.emit, len(ids) - 1)
                best = np.argpartition(dist, k - 1, axis=1)[:, :k]
                found = np.take_along_axis(dist, best, 1)
                row, col = np.nonzero(np.isfinite(found))
                a.append(ids[row])
                b.append(ids[best[row, col]])
                d.append(found[row, col])
            yield _edge_batch(a, b, d)

    found = lists.select("m").mapInArrow(compare, EDGE)
    old = graph.select("node", "nbr", "dist", F.lit(False).alias("fresh"))
    merged = old.unionByName(found.withColumn("fresh", F.lit(True))).groupBy("node", "nbr").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    return _best_edges(merged, how.k).drop("place")


def build_graph(nodes: DataFrame, how: Descent) -> DataFrame:
    """Edges (``node``, ``nbr``, ``dist``, ``fresh``), at most ``how.k`` a node."""
    graph = materialise(_best_edges(first_graph(nodes, how), how.k).drop("place").withColumn("fresh", F.lit(True)), "graph")
    for turn in range(how.rounds):
        old, graph = graph, materialise(descend(graph, nodes, how, turn), "graph")
        discard(old)
        counts = graph.agg(F.count(F.lit(1)).alias("n"), F.count_if("fresh").alias("fresh")).first()
        if counts["fresh"] <= how.least_change * counts["n"]:
            break
    return graph


def _lengths(gap: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; where squares would leave the range of doubles, of rows brought to size 1 first."""
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((gap * gap).sum(axis=1))
    odd = ~((out > 1e-140) & (out < 1e150))
    if odd.any():
        size = np.abs(gap[odd]).max(axis=1)
        size[size == 0] = 1.0
        out[odd] = size * np.sqrt(((gap[odd] / size[:, None]) ** 2).sum(axis=1))
    return out


def _measure(pairs: DataFrame) -> DataFrame:
    """(q, node, qv, v) -> (q, node, dist) in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                gap = _rows(batch.column(2), "<f8") - _rows(batch.column(3), "<f8")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_lengths(gap))], ["q", "node", "dist"])

    return pairs.select("q", "node", "qv", "v").mapInArrow(run, "q long, node long, dist double")


def walk(graph: DataFrame, nodes: DataFrame, starts: DataFrame, how: Descent) -> DataFrame:
    """Greedy search from ``starts`` (node): the ``beam`` nearest nodes found for each, as (q, node, dist)."""
    edges = graph.select("node", "nbr").unionByName(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()
    edges = materialise(edges, "edges")
    vectors = nodes.select("node", "v")
    queries = materialise(starts.distinct().join(vectors, "node").select(F.col("node").alias("q"), F.col("v").alias("qv")), "queries")
    own = queries.select("q", F.col("q").alias("node"), F.lit(0.0).alias("dist"), F.lit(False).alias("seen"))
    entries = F.broadcast(vectors.orderBy(F.xxhash64("node"), "node").limit(how.entries))
    drawn = _measure(queries.crossJoin(entries).filter(F.col("q") != F.col("node"))).withColumn("seen", F.lit(False))
    beam = materialise(own.unionByName(drawn), "beam")
    order = W.partitionBy("q").orderBy("dist", "node")
    while True:
        old_beam = beam
        unseen = beam.filter(~F.col("seen")).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= how.width).select("q", "node")
        reached = unseen.join(edges, "node").select("q", F.col("nbr").alias("node")).distinct()
        reached = reached.join(beam.select("q", "node"), ["q", "node"], "left_anti")
        found = _measure(reached.join(vectors, "node").join(queries, "q")).withColumn("seen", F.lit(False))
        marked = beam.join(unseen.withColumn("now", F.lit(True)), ["q", "node"], "left").select("q", "node", "dist", (F.col("seen") | F.coalesce("now", F.lit(False))).alias("seen"))
        beam = marked.unionByName(found).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= how.beam).drop("turn")
        beam = materialise(beam, "beam")
        discard(old_beam)
        # Every round marks what it expands, and a beam only gets nearer, so this ends.
        if beam.filter(~F.col("seen")).isEmpty():
            break
    discard(edges, queries)
    return materialise(beam.select("q", "node", "dist"), "walked")


def exactly(nodes: DataFrame, starts: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest nodes of each of ``starts`` (node) among all, as (q, node, dist): blocks of nodes against blocks of queries."""
    queries = materialise(starts.distinct().join(nodes.select("node", "v"), "node"), "short")

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64("node"), F.lit(math.ceil(max(1, df.count()) / size)))
        return df.groupBy(part.alias("part")).agg(F.collect_list(F.struct("node", "v")).alias(name)).select(name)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked, some = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                ids, m = some.field("node").to_numpy(), _rows(some.field("v"), "<f8")
                for q, v in zip(asked.field("node").to_numpy(), _rows(asked.field("v"), "<f8"), strict=True):
                    dist = _lengths(m - v)
                    best = np.lexsort((ids, dist))[:keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(ids[best]), pa.array(dist[best])], ["q", "node", "dist"])

    pairs = blocks(queries, 16, "asked").crossJoin(blocks(nodes.select("node", "v"), 128, "some"))
    found = pairs.select("asked", "some").mapInArrow(compare, "q long, node long, dist double")
    return found.withColumn("turn", F.row_number().over(W.partitionBy("q").orderBy("dist", "node"))).filter(F.col("turn") <= keep).drop("turn")


def search(rows: DataFrame, is_query: Column, top: int = 10, how: Descent | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``top`` nearest other rows of every row that ``is_query`` (on ``vec_id``) picks: query_id, rank, vec_id, score."""
    how = how or Descent()
    valid = materialise(usable(rows, id_col, vector_col), "usable")
    nodes, members = nodes_of(valid, top + 1)
    asked = valid.filter(is_query).select(F.col("vec_id").alias("query_id"), "v")
    firsts = nodes_key(valid)
    asked = materialise(asked.join(firsts, "v").select("query_id", F.col("node").alias("q")), "asked")
    found = walk(build_graph(nodes, how), nodes, asked.select(F.col("q").alias("node")), how)

    def members_of(found: DataFrame) -> DataFrame:
        return _best(found.withColumnRenamed("dist", "score").join(members, "node").select("q", "score", "vec_id"), "q", top + 1)

    near = materialise(members_of(found), "near")
    short = near.groupBy("q").count().filter(F.col("count") < min(top + 1, valid.count())).select("q")
    if not short.isEmpty():
        whole = exactly(nodes, short.select(F.col("q").alias("node")), top + 1)
        near = near.join(short, "q", "left_anti").unionByName(members_of(whole).select(near.columns))
    pairs = asked.join(near, "q").filter(F.col("vec_id") != F.col("query_id"))
    return _best(pairs, "query_id", top, "rank").select("query_id", "rank", "vec_id", "score")


def nodes_key(valid: DataFrame) -> DataFrame:
    return valid.groupBy("v").agg(F.min("vec_id").alias("node"))


def _best(df: DataFrame, by: str, n: int, name: str = "_lt_rank") -> DataFrame:
    order = W.partitionBy(by).orderBy("score", "vec_id")
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n)
