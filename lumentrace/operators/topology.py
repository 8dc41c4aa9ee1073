"""Topology over the hop table (path_id, pos, board, node, kind, role): adjacency, nearest boards, services, audits.

Paths partition everything: a window over one path holds its hops only, and what crosses paths is an aggregate
with partial sums. No operator collects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S

from .preparation import ranked

#: Roots of ``khop_region`` that travel in one mask.
MASK_BITS = 60
FTYPES = ("ODUk-Creation", "ODUk-Termination", "OTUk-Relay", "OTUk-RegenIn", "OTUk-RegenOut")


def in_path() -> WindowSpec:
    return W.partitionBy("path_id").orderBy("pos")


def role_map(hops: DataFrame) -> DataFrame:
    """First non-empty role of a board over paths in order."""
    return hops.filter(F.col("role") != "").groupBy("board").agg(F.min_by("role", F.struct("path_id", "pos")).alias("role"))


def typed_boards(boards: DataFrame, hops: DataFrame) -> DataFrame:
    roles = role_map(hops)
    df = boards.join(roles, "board", "left").withColumn("role", F.coalesce("role", F.lit("")))
    return df.withColumn("ftype", S.function_type(F.col("kind"), F.col("role")))


def pairs(hops: DataFrame) -> DataFrame:
    """Consecutive hops."""
    nxt = {f"dst{s}": F.lead(c).over(in_path()) for s, c in (("", "board"), ("_kind", "kind"), ("_node", "node"))}
    df = hops.withColumns(nxt).filter(F.col("dst").isNotNull())
    return df.select("path_id", "pos", F.col("board").alias("src"), F.col("kind").alias("src_kind"), F.col("node").alias("src_node"), "dst", "dst_kind", "dst_node")


def edges(hops: DataFrame) -> DataFrame:
    return pairs(hops).select("src", "dst", "src_node", "dst_node", S.edge_type(F.col("src_kind"), F.col("dst_kind")).alias("edge_type")).distinct()


def adjacency(hops: DataFrame) -> DataFrame:
    """Edges in both directions: board, neighbour, direction, edge_type."""
    e = edges(hops)
    down = e.select(F.col("src").alias("board"), F.col("dst").alias("neighbour"), F.lit("D").alias("direction"), "edge_type")
    return down.unionByName(e.select(F.col("dst").alias("board"), F.col("src").alias("neighbour"), F.lit("U").alias("direction"), "edge_type"))


def with_boundary(hops: DataFrame) -> DataFrame:
    """Hops with ``over``, the next board if the step to it crosses a regenerator: what ``boundaries`` needs, added where paths lie together anyway."""
    crossed = (F.col("kind") == "REGENIN") & (F.lead("kind").over(in_path()) == "REGENOUT")
    return hops.withColumn("over", F.when(crossed, F.lead("board").over(in_path())))


def boundaries(hops: DataFrame) -> DataFrame:
    """The edges of ``adjacency`` that cross a regenerator downstream, of hops ``with_boundary``."""
    return hops.filter("over is not null").select("board", F.col("over").alias("neighbour"), F.lit("D").alias("direction"), F.lit("regen_boundary").alias("edge_type")).distinct()


def nearest_of_type(hops: DataFrame, typed: DataFrame, sectioned: bool = False, parts: int | None = None, wanted: set | None = None) -> DataFrame:
    """Per board, direction and function type: the first board of that type on each path, distinct.

    With ``sectioned``, relay boards do not look past a regenerator (which may itself be the target), and the edge
    type of the first step on the smallest path is added. One window per path and type, no self-join. ``parts``: of the exchange by path.
    ``wanted``: the (function type, direction, type looked for) that are asked for, all if not given.
    """
    here = hops.select("path_id", "pos", "board", "kind")
    here = here if parts is None else here.repartition(parts, "path_id")
    types = typed.select("board", "ftype")
    df = here.join(F.broadcast(types) if types.count() <= MAX_LABELS else types, "board")
    out = []
    asked = lambda direction, t: {f for f, way, to in wanted if (way, to) == (direction, t)}
    for direction, order in (("D", F.col("pos")), ("U", -F.col("pos"))):
        # From the path's far end on: what lies ahead is the part of the window already read, and its last row is the nearest.
        looked = [t for t in FTYPES if wanted is None or asked(direction, t)]
        if not looked:
            continue
        back = W.partitionBy("path_id").orderBy(-order)
        nearest = lambda cond: F.last(F.when(cond, F.struct(order.alias("o"), "board")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))  # noqa: B023, E731
        here = df.withColumns({"next_kind": F.lag("kind").over(back), "wall": nearest(F.col("kind").isin("REGENIN", "REGENOUT")), **{f"t_{t}": nearest(F.col("ftype") == t) for t in looked}})
        a, b = (F.col("kind"), F.col("next_kind")) if direction == "D" else (F.col("next_kind"), F.col("kind"))
        hit = lambda t: F.col(f"t_{t}") if wanted is None else F.when(F.col("ftype").isin(asked(direction, t)), F.col(f"t_{t}"))  # noqa: B023, E731
        each = F.array(*[F.struct(F.lit(t).alias("to_type"), hit(t).alias("hit")) for t in looked])
        found = here.select("path_id", "board", "ftype", "wall", S.edge_type(a, b).alias("edge_type"), F.explode(each).alias("x")).filter("x.hit is not null")
        if sectioned:
            found = found.filter((F.col("ftype") != "OTUk-Relay") | F.col("wall").isNull() | (F.col("x.hit.o") <= F.col("wall.o")))
        out.append(found.select("path_id", "board", F.lit(direction).alias("direction"), "x.to_type", F.col("x.hit.board").alias("target"), "edge_type"))
    if not out:
        empty = df.filter("false").select("path_id", "board", *[F.lit("").alias(c) for c in ("direction", "to_type")], F.col("board").alias("target"), F.lit("").alias("edge_type"))
    both = reduce(DataFrame.unionByName, out) if out else empty
    keys = ["board", "direction", "to_type", "target"]
    if not sectioned:
        return both.select(*keys).distinct()
    return both.groupBy(*keys).agg(F.min(F.struct("path_id", "edge_type"))["edge_type"].alias("edge_type"))


def node_path(hops: DataFrame) -> DataFrame:
    """Nodes of a path without consecutive repeats: path_id, step, node."""
    df = hops.withColumn("prev", F.lag("node").over(in_path())).filter(F.col("prev").isNull() | (F.col("prev") != F.col("node")))
    return df.select("path_id", F.row_number().over(in_path()).alias("step"), "node")


def node_graph(hops: DataFrame) -> DataFrame:
    e = pairs(hops).filter(F.col("src_node") != F.col("dst_node"))
    return e.select(F.least("src_node", "dst_node").alias("a"), F.greatest("src_node", "dst_node").alias("b")).distinct()


def board_catalog(boards: DataFrame) -> DataFrame:
    return boards.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("boards"), F.count(F.lit(1)).alias("n_boards"))


def board_map(boards: DataFrame) -> DataFrame:
    return boards.groupBy("node", "kind").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("boards"))


def services(hops: DataFrame) -> DataFrame:
    """One per path of two nodes or more: end nodes, node path, segments."""
    w = W.partitionBy("path_id").orderBy("step")
    np = node_path(hops).withColumn("nxt", F.lead("node").over(w))
    seg = F.when(F.col("nxt").isNotNull(), S.segment_id(F.col("node"), F.col("nxt")))
    g = np.withColumn("seg", seg).groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("step", "node", "seg"))).alias("x"))
    return g.filter(F.size("x") > 1).select(
        "path_id",
        F.element_at("x", 1)["node"].alias("src"),
        F.element_at("x", -1)["node"].alias("dst"),
        F.array_join(F.transform("x", lambda s: s["node"].cast("string")), ",").alias("node_path"),
        F.array_join(F.transform(F.slice("x", F.lit(1), F.size("x") - 1), lambda s: s["seg"]), ",").alias("segments"),
    )


def query_topology(hops: DataFrame, keys: DataFrame) -> DataFrame:
    """Per asked board: its neighbours and how many paths and places hold it. ``keys`` (board) may be of any size."""
    w = hops.withColumns({"up": F.lag("board").over(in_path()), "down": F.lead("board").over(in_path())}).join(keys, "board", "left_semi")
    g = w.groupBy("board").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("up")), lambda x: x.cast("string")), ",").alias("upstream"),
        F.array_join(F.transform(F.sort_array(F.collect_set("down")), lambda x: x.cast("string")), ",").alias("downstream"),
        F.countDistinct("path_id").alias("n_paths"),
        F.count(F.lit(1)).alias("n_places"),
    )
    return g


def trace_paths(hops: DataFrame) -> DataFrame:
    """Per path: boards in order, nodes and domains crossed."""
    g = hops.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("pos", "board"))).alias("x"), F.countDistinct("node").alias("n_nodes"), F.countDistinct("domain").alias("n_domains"))
    return g.select("path_id", F.array_join(F.transform("x", lambda s: s["board"].cast("string")), ">").alias("trace"), "n_nodes", "n_domains", (F.col("n_domains") > 1).alias("multi_domain"))


def downstream_index(hops: DataFrame, least: int = 1) -> DataFrame:
    """Most boards after a board on any path; boards with ``least`` or more."""
    return hops.groupBy("board").agg(F.max(F.col("n") - F.col("pos")).alias("max_downstream")).filter(F.col("max_downstream") >= least)


def downstream_region(hops: DataFrame, k: int) -> DataFrame:
    """Per board the k boards from it on along a path: the longest such run, the smallest path among equals."""
    run = F.collect_list("board").over(in_path().rowsBetween(0, k - 1))
    df = hops.select("path_id", "pos", "board", run.alias("run"))
    best = df.groupBy("board").agg(F.min_by("run", F.struct(-F.size("run"), "path_id", "pos")).alias("run"))
    return best.select("board", F.size("run").alias("size"), F.array_join(F.transform("run", lambda x: x.cast("string")), ",").alias("region"))


def stream_sides(hops: DataFrame, failed: DataFrame) -> DataFrame:
    """All boards before and after each failed board, with counts; the join has the path as equi key."""
    at = hops.join(failed, "board", "left_semi").select("path_id", F.col("board").alias("failed"), F.col("pos").alias("at"))
    j = at.join(hops.select("path_id", "pos", "board"), "path_id").filter(F.col("pos") != F.col("at"))
    return j.select("failed", F.when(F.col("pos") < F.col("at"), "up").otherwise("down").alias("side"), "board").distinct()


def topology_summary(hops: DataFrame) -> DataFrame:
    return hops.agg(
        F.countDistinct("path_id").alias("n_paths"),
        F.countDistinct("board").alias("n_boards"),
        F.count_if(F.col("role") == "SRC").alias("n_src"),
        F.count_if(F.col("role") == "TERMINATION").alias("n_term"),
        F.max("n").alias("max_hops"),
        F.count(F.lit(1)).alias("n_hops"),
    )


def endpoint_audit(boards: DataFrame) -> DataFrame:
    """Nodes that lack an electrical kind."""
    g = boards.groupBy("node").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("TRIB", "XCON", "LINE")])
    return g.withColumn("missing", F.concat_ws(",", *[F.when(F.col(f"n_{k.lower()}") == 0, k) for k in ("TRIB", "XCON", "LINE")])).filter(F.col("missing") != "")


def repeated_boards(hops: DataFrame) -> DataFrame:
    """Paths in which a board repeats."""
    g = hops.groupBy("path_id").agg(F.count(F.lit(1)).alias("n_hops"), F.countDistinct("board").alias("n_distinct"))
    return g.filter(F.col("n_hops") != F.col("n_distinct"))


def optical_trails(hops: DataFrame) -> DataFrame:
    """Ends of each path's optical part."""
    o = hops.filter(F.col("kind").isin("OM", "OA", "OD", "FIU", "REGENIN", "REGENOUT"))
    return o.groupBy("path_id").agg(F.min_by("board", "pos").alias("first"), F.max_by("board", "pos").alias("last"), F.count(F.lit(1)).alias("n_optical"))


def first_of_kind(hops: DataFrame) -> DataFrame:
    return hops.groupBy("kind").agg(F.min_by("board", F.struct("path_id", "pos")).alias("board"))


def positional_roles(hops: DataFrame) -> DataFrame:
    """Role by label, else electrical kind, else place: first three SRC, last three TERMINATION, the rest RELAY."""
    place = F.when(F.col("pos") <= 3, "SRC").when(F.col("pos") > F.col("n") - 3, "TERMINATION").otherwise("RELAY")
    return hops.select("path_id", "pos", "board", F.when(F.col("role") != "", F.col("role")).when(S.board_category(F.col("kind")) == "Fiber", "RELAY").otherwise(place).alias("role"))


def degree(hops: DataFrame, boards: DataFrame) -> DataFrame:
    """Average degree over boards with an edge, and over all boards."""
    e = edges(hops).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    d = e.select(F.explode(F.array("a", "b")).alias("board")).groupBy("board").agg(F.count(F.lit(1)).alias("d"))
    return boards.select("board").join(d, "board", "left").agg(F.avg("d").alias("avg_connected"), (F.coalesce(F.sum("d"), F.lit(0)) / F.count(F.lit(1))).alias("avg_all"))


def path_length_stats(hops: DataFrame) -> DataFrame:
    g = hops.groupBy("path_id").agg(F.count(F.lit(1)).alias("len"), F.countDistinct("node").alias("nodes"))
    return g.agg(F.avg("len").alias("avg_len"), F.max("len").alias("max_len"), F.min("len").alias("min_len"), F.avg("nodes").alias("avg_nodes"))


def traverse_coverage(hops: DataFrame, boards: DataFrame) -> DataFrame:
    on = hops.select("board").distinct().withColumn("on", F.lit(1))
    return boards.select("board", "domain").join(on, "board", "left").groupBy("domain").agg(F.avg(F.coalesce("on", F.lit(0))).alias("coverage"), F.count_if(F.col("on").isNull()).alias("untraversed"))


def domain_stats(hops: DataFrame, boards: DataFrame) -> DataFrame:
    per_node = boards.groupBy("domain", "node").agg(F.count(F.lit(1)).alias("n"))
    a = per_node.groupBy("domain").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n").alias("n_boards"), F.min("n").alias("min_per_node"), F.max("n").alias("max_per_node"), F.avg("n").alias("avg_per_node"))
    b = hops.groupBy("domain").agg(F.countDistinct("path_id").alias("n_paths"), F.count(F.lit(1)).alias("n_hops"))
    return a.join(b, "domain", "left").select("*", (F.col("n_hops") / F.col("n_paths")).alias("avg_hops"))


def service_roles(hops: DataFrame, regen_every: int = 3) -> DataFrame:
    """Functions of each service: ends, relays, and a regenerator pair after every ``regen_every`` segments."""
    np = node_path(hops).withColumn("m", F.count(F.lit(1)).over(W.partitionBy("path_id"))).filter("m > 1")
    inner = (F.col("step") > 1) & (F.col("step") < F.col("m"))
    roles = F.when(F.col("step") == 1, F.array(F.lit("SRC"))).when(F.col("step") == F.col("m"), F.array(F.lit("SNK"))).when(inner & ((F.col("step") - 1) % regen_every == 0), F.array(F.lit("SNK"), F.lit("SRC"))).otherwise(F.array(F.lit("RELAY_IN"), F.lit("RELAY_OUT")))
    return np.select("path_id", "step", "node", F.posexplode(roles).alias("k", "role"))


def khop_region(edges_df: DataFrame, roots: DataFrame, hops_max: int, materialise) -> DataFrame:
    """Boards within ``hops_max`` undirected steps of each root: root, board, hop. A join per level over the frontier.

    Sixty roots travel as the bits of one mask per board, as in ``propagation.walk``: a level joins boards with their neighbours
    once for all of them, and bits become rows at the end.
    """
    e = edges_df.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges_df.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    k = F.col("k") - 1
    placed = materialise(ranked(roots.select(F.col("board").alias("root")).distinct(), F.col("root")).select("root", F.floor(k / MASK_BITS).alias("block"), (k % MASK_BITS).cast("int").alias("bit")), "roots")
    own = F.expr("shiftleft(CAST(1 AS BIGINT), bit)")
    frontier = seen = placed.select("block", F.col("root").alias("board"), own.alias("mask"), F.lit(0).alias("hop"))
    for h in range(1, hops_max + 1):
        step = frontier.join(e, F.col("board") == F.col("a")).groupBy("block", F.col("b").alias("board")).agg(F.bit_or("mask").alias("mask"))
        known = seen.groupBy("block", "board").agg(F.bit_or("mask").alias("known"))
        new = step.join(known, ["block", "board"], "left").withColumn("mask", F.expr("mask & ~coalesce(known, 0L)")).filter("mask <> 0")
        frontier = materialise(new.select("block", "board", "mask", F.lit(h).alias("hop")), "khop")
        seen = seen.unionByName(frontier)
    bits = F.explode(F.expr(f"filter(sequence(0, {MASK_BITS - 1}), i -> (shiftright(mask, i) & 1) = 1)"))
    return seen.select("block", "board", "hop", bits.alias("bit")).join(placed, ["block", "bit"]).select("root", "board", "hop")


#: Labels (two numbers each) up to which they are broadcast to the edges.
MAX_LABELS = 500_000


def connected_components(edges_df: DataFrame, boards: DataFrame, materialise, most: int = MAX_LABELS) -> DataFrame:
    """board, component (its smallest board), isolated boards included: smallest label of the neighbourhood, then of the label's own.

    Up to ``most`` boards, their labels go to the edges, which lie where they are and send on a least label a board and task.
    """
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges_df.select(F.explode(F.array(way("src", "dst"), way("dst", "src"))).alias("e")).select("e.a", "e.b")
    label = boards.select("board", F.col("board").alias("component"))
    few = label.count() <= most
    both = both if few else both.distinct()
    while True:
        near = both.join(F.broadcast(label) if few else label, F.col("a") == F.col("board")).groupBy("b").agg(F.min("component").alias("m"))
        label = label.join(near, F.col("board") == F.col("b"), "left").select("board", F.least("component", "m").alias("component"), F.col("component").alias("before"))
        jump = label.select(F.col("board").alias("component"), F.col("component").alias("further"))
        label = materialise(label.join(jump, "component", "left").select("board", F.least("component", "further").alias("component"), "before"), "components")
        changed = label.filter(F.col("component") != F.col("before"))
        label = label.drop("before")
        if changed.isEmpty():
            return label
