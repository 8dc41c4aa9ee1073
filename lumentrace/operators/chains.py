"""Growth along links: regions with a quota, chains of hops and their classes, trails that pass certain vertices only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .preparation import draw


def both_ways(edges: DataFrame, dealt: bool = False) -> DataFrame:
    """``a``, ``b`` of edges (src, dst) in both directions, once each, without loops; ``dealt`` by ``a``, which a join by it can use."""
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    return (both.repartition("a") if dealt else both).distinct()


def connected_regions(edges: DataFrame, roots: DataFrame, materialise, seed: int = 0) -> DataFrame:
    """A connected set of exactly ``k`` boards for each root (root, k), or all that its component holds: root, board, hop.

    Regions grow level by level. Neighbours not yet inside are ordered by a hash of root and board, and a root takes as many of
    them as its quota leaves, so a level is cut only where a region is complete; all that is taken touches the level before.
    Roots with a quota under 1, or none, have the root alone; a root given twice keeps its larger quota.
    """
    e = both_ways(edges, dealt=True)
    quota = roots.filter("root is not null").groupBy("root").agg(F.greatest(F.lit(1), F.coalesce(F.max("k"), F.lit(1))).alias("k"))
    front = region = materialise(quota.select("root", F.col("root").alias("board"), F.lit(0).alias("hop"), F.lit(1).cast("long").alias("have"), "k"), "region")
    most = int(quota.agg(F.max("k")).first()[0] or 1)
    drawn = (draw(F.col("board") * 31 + F.col("root"), seed), F.col("board"))
    order, near = W.partitionBy("root").orderBy(*drawn), W.partitionBy("root", "a").orderBy(*drawn)
    hop = 0
    while True:
        hop += 1
        open_ = front.filter("have < k").select("root", F.col("board").alias("a"), "have", "k")
        # Of a board's neighbours at most ``have`` lie inside, so the first ``k`` in the order hold all that can be taken. They are cut
        # where the join leaves them, dealt by neighbour however it is done; the first filter, by a number, keeps the sorted rows few.
        step = open_.repartition("a").join(e, "a").withColumnRenamed("b", "board").withColumn("near", F.row_number().over(near)).filter(F.col("near") <= most).filter("near <= k")
        # What lies inside goes along, so that one exchange by root serves the distinct rows, those left out and the order.
        inside = region.select("root", "board", F.lit(None).cast("long").alias("have"), F.lit(None).cast("long").alias("k"))
        both = step.select("root", "board", "have", F.col("k").cast("long").alias("k")).unionByName(inside).repartition("root")
        new = both.groupBy("root", "board").agg(F.max("have").alias("have"), F.max("k").alias("k"), F.max(F.col("have").isNull()).alias("known")).filter("not known").drop("known")
        taken = new.withColumn("place", F.row_number().over(order)).filter(F.col("place") < most).filter(F.col("place") <= F.col("k") - F.col("have"))
        taken = taken.withColumn("have", F.col("have") + F.count(F.lit(1)).over(W.partitionBy("root"))).withColumn("hop", F.lit(hop))
        front = materialise(taken.select("root", "board", "hop", "have", "k"), "region")
        if front.isEmpty():
            return region.select("root", "board", "hop")
        region = region.unionByName(front)


def hop_chains(links: DataFrame, most: int = 3, with_: dict[str, str] | None = None, keep: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """All chains of one to ``most`` links (src, dst): columns ``h0`` to ``h{most}``, null beyond a chain's end.

    ``with_`` names what goes along with each place, so that it need not be looked up afterwards: links hold it as src_<name> and
    dst_<name>, chains as <prefix>0 to <prefix>{most}. ``keep`` are columns of a chain's first link. ``parts``: of the exchanges by place.
    """
    named = with_ or {}
    step = links.select(F.col("src").alias("at"), F.col("dst").alias("on"), *[F.col(f"dst_{c}").alias(f"on_{p}") for c, p in named.items()])
    chain = links.select(F.col("src").alias("h0"), F.col("dst").alias("h1"), *[F.col(f"{end}_{c}").alias(f"{p}{i}") for c, p in named.items() for i, end in enumerate(("src", "dst"))], *keep)
    out = [chain]
    for n in range(2, most + 1):
        dealt = chain if parts is None else chain.repartition(parts, f"h{n - 1}")
        new = [F.col("on").alias(f"h{n}"), *[F.col(f"on_{p}").alias(f"{p}{n}") for p in named.values()]]
        chain = dealt.join(step if parts is None else step.repartition(parts, "at"), F.col(f"h{n - 1}") == F.col("at")).select(*chain.columns, *new)
        out.append(chain)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def chain_class(*places: Column) -> Column:
    """Number of hops by the null pattern of a chain's places; null for a chain without a first hop or with a gap."""
    n = len(places)
    fits = [reduce(Column.__and__, [p.isNotNull() if i <= k else p.isNull() for i, p in enumerate(places)]) for k in range(1, n)]
    return reduce(lambda case, k: case.when(fits[k - 1], k), range(2, n), F.when(fits[0], 1))


def filter_chains(candidates: DataFrame, training: DataFrame, features: list[str], most: int = 3, least: float = 0.5) -> DataFrame:
    """Candidate chains (h0.., ``gt``, ``score``, features) scored above ``least`` whose features occur, nulls alike, among training
    chains with ``gt`` 1 of whatever class; ``n_hops`` is the class, and chains of none drop out."""
    places = [F.col(f"h{i}") for i in range(most + 1)]
    known = training.filter("gt = 1").select(*[F.col(f).alias(f"_{f}") for f in features]).distinct()
    same = reduce(Column.__and__, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in features])
    scored = candidates.filter(F.col("score") > least).withColumn("n_hops", chain_class(*places)).filter("n_hops is not null")
    return scored.join(known, same, "left_semi").select(*places, "gt", "score", "n_hops")


def trail_links(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """What trails go along: a, b both ways, and whether b is a stop. ``vertices``: v, stop."""
    return both_ways(edges).join(vertices.select(F.col("v").alias("b"), "stop"), "b")


def constrained_trails(edges: DataFrame, vertices: DataFrame, materialise, most: int, links: DataFrame | None = None) -> DataFrame:
    """Shortest trails of at most ``most`` steps between stops whose inner vertices are none: a, b, steps, trail (a < b).

    ``vertices``: v, stop. The search goes out from every stop, level by level, and never leaves a stop it has reached; of
    several shortest trails the smallest counts. Each root keeps what it has seen, so a trail is not walked twice. The last
    step goes to stops only, as no trail leads on from it: else it would hold each root with all vertices of its neighbourhood.

    A root's trails to smaller stops are those of the smaller stop, so no level holds them. Rows hold the inner vertices only, and what a root
    has seen goes along with a level's rows, so that one exchange by root serves both. ``links``: ``trail_links``, written down, as every level reads them.
    """
    e = trail_links(edges, vertices) if links is None else links
    front = seen = vertices.filter("stop").select(F.col("v").alias("root"), F.col("v").alias("at"), F.expr("slice(array(v), 1, 0)").alias("inner"), F.lit(False).alias("stop"))
    ends = None
    for k in range(most):
        last = k == most - 1
        step = front.filter("not stop").drop("stop").join(e.filter("stop") if last else e, F.col("at") == F.col("a")).filter(F.col("root") < F.col("b") if last else ~F.col("stop") | (F.col("root") < F.col("b")))
        inner = F.concat("inner", F.array("at")) if k else F.col("inner")
        step = step.select("root", F.col("b").alias("at"), inner.alias("inner"), "stop", F.lit(False).alias("known"))
        before = seen.filter("stop") if last else seen
        both = step.unionByName(before.select("root", "at", F.lit(None).cast(step.schema["inner"].dataType).alias("inner"), "stop", F.lit(True).alias("known"))).repartition("root")
        new = both.groupBy("root", "at").agg(F.min("inner").alias("inner"), F.max("stop").alias("stop"), F.max("known").alias("known")).filter("not known")
        front = materialise(new.select("root", "at", "inner", "stop"), "trails")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        got = front.filter("stop")
        ends = got if ends is None else ends.unionByName(got)
    if ends is None:
        ends = front.filter("stop")
    trail = F.concat(F.array("root"), "inner", F.array("at"))
    return ends.select(F.col("root").alias("a"), F.col("at").alias("b"), (F.size("inner") + 1).alias("steps"), trail.alias("trail"))


#: Marks by which a neighbour of an endpoint token tells its side. In the first grammar either neighbour may be a mux or
#: a demux, and the copy stays; in the second muxes follow, demuxes precede, and the copy is 0.
SIDES = (
    {"L": ("-OM2", "-OD2"), "U": ("-OM1", "-OD1")},
    {"L": ("-OM2", "-OD2"), "U": ("-OM1", "-OD1")},
)
STRICT_SIDES = ({"L": ("OM2",), "U": ("OM1",)}, {"L": ("OD2",), "U": ("OD1",)})


def translate_tokens(tokens: Column, sides=SIDES, keep_copy: bool = True) -> Column:
    """Board tokens of a path with each ``-OTU`` as Line1 (side U) or Line2 (side L) of its node.

    The side comes from the next token, else from the one before, else it is U; a null path stays null.
    """
    says = lambda t, marks: F.when(reduce(Column.__or__, [t.contains(m) for m in marks["L"]]), "L").when(reduce(Column.__or__, [t.contains(m) for m in marks["U"]]), "U")
    after, before = sides
    # Each token with its neighbours, so that one pass sees all three.
    near = F.arrays_zip(tokens.alias("t"), F.concat(F.slice(tokens, F.lit(2), F.size(tokens)), F.array(F.lit(""))).alias("n"), F.concat(F.array(F.lit("")), tokens).alias("p"))

    def one(x: Column) -> Column:
        side = F.coalesce(says(x["n"], after), says(x["p"], before), F.lit("U"))
        copy = F.when(x["t"].contains("$"), F.regexp_extract(x["t"], r"([^$]*)$", 1)).otherwise("0") if keep_copy else F.lit("0")
        line = F.concat(F.substring_index(x["t"], "-", 1), F.lit("-Line"), F.when(side == "L", "2").otherwise("1"), F.lit("$"), copy)
        return F.when(x["t"].contains("-OTU"), line).otherwise(x["t"])

    return F.transform(F.slice(near, F.lit(1), F.size(tokens)), one)
