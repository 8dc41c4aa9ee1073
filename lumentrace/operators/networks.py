"""Service functions, their edges and boards, optical reach, impact over time, audits and reports of a network.

Tables as in ``topology``: hops (path_id, pos, n, board, node, domain, kind, role) and boards (board, node, domain, kind).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S

from . import topology as T

OPTICAL = ("OM", "OA", "OD", "FIU", "REGENIN", "REGENOUT")
#: Kinds that stand for a role at a node, in order of preference.
ROLE_KINDS = {"SRC": ("TRIB", "XCON", "LINE", "OM"), "RELAY": ("OA", "FIU", "OD"), "SNK": ("OD", "LINE", "XCON", "TRIB")}


def service_functions(hops: DataFrame, regen_every: int = 3) -> DataFrame:
    """Functions of every service in order: (path_id, step, k, node, role, id, regen).

    SRC and an outgoing relay at the start, incoming relay and SNK at the end, both relays between, and at every
    ``regen_every``-th inner node a SNK and SRC pair between them. Relays belong to a segment, so services share them.
    """
    w = W.partitionBy("path_id").orderBy("step")
    np = T.node_path(hops).withColumns({"m": F.count(F.lit(1)).over(W.partitionBy("path_id")), "prev": F.lag("node").over(w), "next": F.lead("node").over(w)}).filter("m > 1")
    text = lambda c: F.col(c).cast("string")
    f = lambda role, kind, *rest, regen=False: F.struct(F.lit(role).alias("role"), F.concat_ws(":", F.lit(kind), text("node"), *rest).alias("id"), F.lit(regen).alias("regen"))
    into, out = f("RELAY_IN", "in", S.segment_id(F.col("prev"), F.col("node"))), f("RELAY_OUT", "out", S.segment_id(F.col("node"), F.col("next")))
    path = text("path_id")
    made = (
        F.when(F.col("step") == 1, F.array(f("SRC", "src", path), out))
        .when(F.col("step") == F.col("m"), F.array(into, f("SNK", "snk", path)))
        .when((F.col("step") - 1) % regen_every == 0, F.array(into, f("SNK", "rsnk", path, regen=True), f("SRC", "rsrc", path, regen=True), out))
        .otherwise(F.array(into, out))
    )
    return np.select("path_id", "step", "node", F.posexplode(made).alias("k", "f")).select("path_id", "step", "k", "node", "f.role", "f.id", "f.regen")


def function_edges(functions: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct edges (a, b, kind) between a service's consecutive functions that both exist: local, prop (along a segment) or regen_boundary."""
    w = W.partitionBy("path_id").orderBy("step", "k")
    e = functions.withColumns({c: F.lead(x).over(w) for c, x in (("b", "id"), ("b_role", "role"), ("b_regen", "regen"))}).filter("b is not null")
    kind = F.when((F.col("role") == "RELAY_OUT") & (F.col("b_role") == "RELAY_IN"), "prop").when(F.col("regen") & F.col("b_regen"), "regen_boundary").otherwise("local")
    e = e.select(F.col("id").alias("a"), "b", kind.alias("kind")).distinct()
    ids = existing.select("id").distinct()
    return e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "kind")


def service_candidates(functions: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct existing functions of each service."""
    return functions.select("path_id", "node", "id").distinct().join(existing.select("id").distinct(), "id", "left_semi").select("path_id", "node", "id")


def first_roles(functions: DataFrame, parts: int | None = None) -> DataFrame:
    """One record per function: that of its first service, and how many services share it.

    A service's repeats are left out where its rows lie, so services are counted without an exchange of the pairs of function and service.
    Relays, which many services share, are then summed up before their exchange; all other ids name their service, and
    nothing can be summed up. ``parts``: of their exchange, so that what a task holds need not grow with the services.
    """
    here = W.partitionBy("path_id", "id").orderBy("step", "k")
    once = functions.withColumn("_n", F.row_number().over(here)).filter("_n = 1")
    shared = F.coalesce(F.col("id").rlike("^(in|out):"), F.lit(False))
    own = once.filter(~shared)
    out = None
    for rows in (once.filter(shared), own if parts is None else own.repartition(parts, "id")):
        g = rows.groupBy("id").agg(F.min(F.struct("path_id", "step", "k", "role", "node")).alias("x"), F.count("path_id").alias("n_services"))
        out = g if out is None else out.unionByName(g)
    return out.select("id", "x.role", "x.node", F.col("x.path_id").alias("first_service"), "n_services")


def relay_groups(functions: DataFrame) -> DataFrame:
    """Segment -> ids of the relay functions on it."""
    relays = functions.filter(F.col("role").startswith("RELAY")).select(F.element_at(F.split("id", ":"), -1).alias("segment"), "id").distinct()
    return relays.groupBy("segment").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("relays"))


def board_for_role(boards: DataFrame, overrides: DataFrame) -> DataFrame:
    """Per node and role the board that stands for it: an override (node, role, board), else the first by its kind's preference."""
    place = lambda kinds: F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(kinds)])
    found = reduce(DataFrame.unionByName, [boards.select("node", "board", F.lit(r).alias("role"), place(k).alias("p")) for r, k in ROLE_KINDS.items()]).filter("p is not null")
    own = found.groupBy("node", "role").agg(F.min_by("board", F.struct("p", "board")).alias("board"))
    o = overrides.groupBy("node", "role").agg(F.min("board").alias("chosen"))
    return own.join(o, ["node", "role"], "full").select("node", "role", F.coalesce("chosen", "board").alias("board"))


def role_paths(functions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each service as text of the boards that stand for its functions, without repeats in a row."""
    role = F.when(F.col("role").startswith("RELAY"), "RELAY").otherwise(F.col("role"))
    f = functions.select("path_id", "step", "k", "node", role.alias("role")).join(chosen, ["node", "role"])
    w = W.partitionBy("path_id").orderBy("step", "k")
    f = f.withColumn("prev", F.lag("board").over(w)).filter(F.col("prev").isNull() | (F.col("prev") != F.col("board")))
    g = f.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("step", "k", "board"))).alias("x"))
    return g.select("path_id", F.array_join(F.transform("x", lambda t: t["board"].cast("string")), ",").alias("boards"))


def function_boards(functions: DataFrame, hops: DataFrame) -> DataFrame:
    """Function -> boards it stands for on its own paths, distinct (id, board).

    SRC: electrical boards and OM of its node up to the first OA or FIU; SNK: from the first OD on, OD and electrical ones;
    relays: the optical ones.
    """
    w = W.partitionBy("path_id", "node").orderBy("pos")
    upto = lambda kinds: F.max(F.col("kind").isin(*kinds)).over(w.rowsBetween(W.unboundedPreceding, 0))
    h = hops.withColumns({"gone": upto(("OA", "FIU")), "demuxed": upto(("OD",))}).select("path_id", "node", "board", "kind", "gone", "demuxed")
    j = functions.select("path_id", "node", "role", "id").join(h, ["path_id", "node"])
    src = (F.col("role") == "SRC") & F.col("kind").isin(*ROLE_KINDS["SRC"]) & ~F.col("gone")
    snk = (F.col("role") == "SNK") & F.col("kind").isin(*ROLE_KINDS["SNK"]) & F.col("demuxed")
    relay = F.col("role").startswith("RELAY") & F.col("kind").isin("OA", "FIU", "OD", "OM")
    return j.filter(src | snk | relay).select("id", "board").distinct()


def expand_series(series: DataFrame, of_function: DataFrame) -> DataFrame:
    """Series of functions (id, t, value) copied to their boards (id, board); a board follows its first function that has a series."""
    first = of_function.join(series.select("id").distinct(), "id", "left_semi").groupBy("board").agg(F.min("id").alias("id"))
    return series.join(first, "id").select("board", "t", "value", "id")


def optical_reach(hops: DataFrame, materialise, most: int = 8) -> DataFrame:
    """From each mux (OM) the nearest mux of another node over optical edges, within ``most`` hops: board, other, hops.

    All muxes search together, level by level, and a mux leaves the search at the level where it finds one: what is kept
    grows with the edges around the muxes, not with the pairs of a mux and a board it can reach.
    """
    p = T.pairs(hops).filter(F.col("src_kind").isin(*OPTICAL) & F.col("dst_kind").isin(*OPTICAL))
    e = materialise(p.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").distinct(), "optical-edges")
    mux = materialise(hops.filter(F.col("kind") == "OM").select("board", "node").distinct(), "muxes")
    there, here = mux.withColumnRenamed("node", "there"), mux.select(F.col("board").alias("root"), "node")
    level = seen = mux.select(F.col("board").alias("root"), "board").distinct().withColumn("hop", F.lit(0))
    found = None
    for h in range(most + 1):
        if h:
            step = level.join(e, F.col("board") == F.col("a")).select("root", F.col("b").alias("board")).distinct()
            level = materialise(step.join(seen.select("root", "board"), ["root", "board"], "left_anti").withColumn("hop", F.lit(h)), "optical-reach")
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        # The first level that holds a mux of another node decides; such a root's search ends there.
        ends = level.join(there, "board").join(here, "root").filter("node <> there")
        ends = materialise(ends.groupBy("root").agg(F.min("board").alias("other"), F.min("hop").alias("hops")), "optical-ends")
        level = level.join(ends.select("root"), "root", "left_anti")
        found = ends if found is None else found.unionByName(ends)
    return found.select(F.col("root").alias("board"), "other", "hops")


def impact_spread(edges: DataFrame, roots: DataFrame, materialise, max_hops: int = 3, decay: float = 0.5, least: float = 0.1) -> DataFrame:
    """Earliest arrival at every board from any root over edges (src, dst, delay) in both directions, and the damping there.

    Of all walks of ``max_hops`` steps or fewer the earliest counts, of equals the shorter; its steps give the scale
    ``decay ** hop``; boards whose scale is below ``least`` are left out. One join and one minimum per step.
    """
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "delay").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "delay"))
    e = materialise(e.groupBy("a", "b").agg(F.min("delay").alias("delay")), "impact-edges")
    best = roots.select("board").distinct().select("board", F.struct(F.lit(0).cast("long").alias("arrival"), F.lit(0).alias("hop")).alias("x"))
    level = best
    for _ in range(max_hops):
        step = level.join(e, F.col("board") == F.col("a")).groupBy(F.col("b").alias("board")).agg(F.min(F.struct((F.col("x.arrival") + F.col("delay")).alias("arrival"), (F.col("x.hop") + 1).alias("hop"))).alias("x"))
        level = materialise(step, "impact")
        best = best.unionByName(level)
    best = best.groupBy("board").agg(F.min("x").alias("x"))
    scale = F.pow(F.lit(decay), F.col("x.hop"))
    return best.filter(scale >= least).select("board", F.col("x.hop").alias("hop"), F.col("x.arrival").alias("arrival"), F.round(scale, 6).alias("scale"))


def endpoint_pairs(boards: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node and index: electrical kinds that are missing, and edges missing between those present. ``boards``: node, idx, kind, board."""
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("board")))
    g = boards.filter(F.col("kind").isin("TRIB", "XCON", "LINE")).groupBy("node", "idx").agg(at("TRIB").alias("t"), at("XCON").alias("x"), at("LINE").alias("l"))
    known = edges.select("src", "dst").distinct()
    for a, b, name in (("t", "x", "tx"), ("x", "l", "xl")):
        g = g.join(known.select(F.col("src").alias(a), F.col("dst").alias(b), F.lit(True).alias(name)), [a, b], "left")
    lacks = F.concat_ws(",", *[F.when(F.col(c).isNull(), k) for c, k in (("t", "TRIB"), ("x", "XCON"), ("l", "LINE"))])
    open_ = F.concat_ws(",", *[F.when(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(n).isNull(), k) for a, b, n, k in (("t", "x", "tx", "TRIB-XCON"), ("x", "l", "xl", "XCON-LINE"))])
    return g.select("node", "idx", lacks.alias("missing"), open_.alias("missing_edges")).filter("missing <> '' or missing_edges <> ''")


def missing_path_edges(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """Consecutive hops that are no edge: path_id, pos, src, dst."""
    return T.pairs(hops).select("path_id", "pos", "src", "dst").join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("path_id", "pos", "src", "dst")


def repeated_endpoints(boards: DataFrame) -> DataFrame:
    """Endpoint boards listed more than once: an error of the table."""
    return boards.groupBy("board").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def fibre_sections(hops: DataFrame) -> DataFrame:
    """Optical steps from node to node, with the number of paths on each."""
    p = T.pairs(hops).filter(F.col("src_kind").isin(*OPTICAL) & F.col("dst_kind").isin(*OPTICAL) & (F.col("src_node") != F.col("dst_node")))
    return p.groupBy("src", "dst").agg(F.countDistinct("path_id").alias("n_paths"))


def node_pair_trails(hops: DataFrame) -> DataFrame:
    """Per pair of adjacent nodes the first path that joins them and its boards there."""
    p = T.pairs(hops).filter(F.col("src_node") != F.col("dst_node"))
    g = p.groupBy(F.least("src_node", "dst_node").alias("a"), F.greatest("src_node", "dst_node").alias("b")).agg(F.min(F.struct("path_id", "pos", "src", "dst")).alias("x"))
    return g.select("a", "b", "x.path_id", "x.src", "x.dst")


def stacked(**domains: DataFrame) -> DataFrame:
    """Tables of several domains under each other, tagged by name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("domain_id", F.lit(name)) for name, df in domains.items()])


def domain_report(hops: DataFrame, boards: DataFrame) -> DataFrame:
    """Per domain: nodes, boards a node, degree, paths that touch it, their node and board hops, and the share of boards on a path."""
    n = F.count(F.lit(1))
    per = boards.groupBy("domain", "node").agg(n.alias("c")).groupBy("domain").agg(n.alias("num_nodes"), F.sum("c").alias("num_boards"), F.min("c").alias("min_per_node"), F.max("c").alias("max_per_node"), F.round(F.avg("c"), 1).alias("mean_per_node"))
    d = T.edges(hops).select("src", "dst").filter("src <> dst").distinct()
    ends = d.select(F.explode(F.array("src", "dst")).alias("board")).groupBy("board").agg(n.alias("deg")).join(boards.select("board", "domain"), "board").groupBy("domain").agg(F.round(F.avg("deg"), 2).alias("avg_degree"))
    steps = T.node_path(hops).groupBy("path_id").agg((n - 1).alias("node_hops"))
    lengths = hops.select("path_id", "domain", (F.col("n") - 1).alias("board_hops")).distinct().join(steps, "path_id")
    over = lambda c: F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 2)
    paths = lengths.groupBy("domain").agg(n.alias("num_paths"), over("node_hops").alias("avg_node_hops"), over("board_hops").alias("avg_board_hops"))
    on = boards.select("board", "domain").join(hops.select("board").distinct().withColumn("on", F.lit(1)), "board", "left").groupBy("domain").agg(F.round(F.avg(F.coalesce("on", F.lit(0))), 4).alias("coverage"))
    return per.join(ends, "domain", "left").join(paths, "domain", "left").join(on, "domain")


def untraversed(hops: DataFrame, boards: DataFrame) -> DataFrame:
    return boards.select("board", "domain").join(hops.select("board").distinct(), "board", "left_anti")


#: Directions of fibres by the boards they join, and of single boards.
FIBRE_UP = (("FIU1", "OA1"), ("OA1", "OD1"), ("OD1", "OM1"), ("OM1", "OA2"), ("OA2", "FIU2"))
FIBRE_DOWN = (("FIU2", "OA3"), ("OA3", "OD2"), ("OD2", "OM2"), ("OM2", "OA4"), ("OA4", "FIU1"))
BOARD_UP, BOARD_DOWN = ("OA1", "OA2", "OD1", "OM1", "FIU2"), ("OA3", "OA4", "OD2", "OM2", "FIU1")


def fibre_direction(a: Column, b: Column) -> Column:
    """U or L of a fibre between two boards of ROADMs; null for pairs that may not be joined."""
    holds = lambda pair: a.contains(pair[0]) & b.contains(pair[1])
    any_of = lambda pairs: reduce(Column.__or__, [holds(p) for p in pairs])
    line = F.when(a.contains("Line") & b.contains("OM1"), "U").when(a.contains("Line") & b.contains("OM2"), "L").when(b.contains("Line") & a.contains("OD1"), "U").when(b.contains("Line") & a.contains("OD2"), "L")
    inner = F.when(any_of((("Tributary", "XCON"), ("XCON", "Line"))), "U")
    return F.coalesce(F.when(holds(("FIU2", "FIU1")), "U").when(holds(("FIU1", "FIU2")), "L"), F.when(any_of(FIBRE_UP), "U").when(any_of(FIBRE_DOWN), "L"), line, inner)


def board_direction(name: Column) -> Column:
    """U, L or / (none) of a ROADM's board; a line card's follows from its number; null for names that are not allowed."""
    any_of = lambda names: reduce(Column.__or__, [name.contains(n) for n in names])
    number = F.coalesce(F.regexp_replace(F.regexp_extract(name, r"-([^$]*)", 1), r"\D", "").try_cast("int"), F.lit(0))
    return F.when(any_of(BOARD_UP), "U").when(any_of(BOARD_DOWN), "L").when(name.contains("Line"), F.when(number % 2 == 1, "U").otherwise("L")).when(any_of(("Tributary", "XCON")), "/")
