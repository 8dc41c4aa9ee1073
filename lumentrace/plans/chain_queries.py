"""Regions, chains, trails, legacy tokens and training logs over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumentrace.operators import chains as C
from lumentrace.operators import evaluation as E
from lumentrace.sources.storage import materialise

from . import bindings as B
from .bindings import sql

Q: dict = {}
O: dict = {}  # noqa: E741


def add(name: str, oracle: str | None):
    def wrap(f):
        if name in Q:
            raise ValueError(f"{name} is registered twice")
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return wrap


# Regions: orders and parts as boards, joined where an order has a line of the part; every order is a root with its own quota.

B.CTES["part_links"] = ((), "SELECT DISTINCT l_orderkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem")
_DRAW = "((board * 31 + root) * 2654435761 + 4) % 1000003"


def _grow(h: int) -> str:
    before = " UNION ALL ".join(f"SELECT root, board FROM g{i}" for i in range(h))
    return f""", c{h} AS (SELECT DISTINCT f.root, e.b AS board, f.have, f.k FROM g{h - 1} f JOIN e ON e.a = f.board WHERE f.have < f.k), d{h} AS (SELECT * FROM c{h} WHERE (root, board) NOT IN ({before})),
g{h} AS MATERIALIZED (SELECT root, board, {h} AS hop, have + count(*) OVER (PARTITION BY root) AS have, k FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY {_DRAW}, board) AS place FROM d{h}) WHERE place <= k - have)"""


@add(
    "connected_region",
    sql(
        """WITH e AS (SELECT src AS a, dst AS b FROM part_links UNION SELECT dst, src FROM part_links), g0 AS (SELECT o_orderkey * 2 AS root, o_orderkey * 2 AS board, 0 AS hop, 1 AS have, 2 + o_orderkey % 12 AS k FROM orders)"""
        + "".join(map(_grow, (1, 2, 3, 4)))
        + " "
        + " UNION ALL ".join(f"SELECT root, board, hop FROM g{h}" for h in range(5)),
        "part_links",
    ),
)
def connected_region(s, d):
    links = B.table(s, d, "lineitem").select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    roots = B.table(s, d, "orders").select((F.col("o_orderkey") * 2).alias("root"), (F.col("o_orderkey") % 12 + 2).alias("k"))
    return C.connected_regions(materialise(links.distinct(), "links"), roots, materialise, 4)


#: Links that one task joins.
LINKS_A_TASK = 250_000

# Chains of events: a board's next event is a hop; features are the alarms along the chain.

B.CTES["next_events"] = ((), "SELECT *, lead(event_id) OVER w AS e1, lead(event_id, 2) OVER w AS e2, lead(event_id, 3) OVER w AS e3 FROM ev WINDOW w AS (PARTITION BY board ORDER BY ts, event_id)")
B.CTES["echains"] = (
    ("ev", "next_events"),
    """SELECT n.event_id AS h0, a.event_id AS h1, b.event_id AS h2, c.event_id AS h3, n.alarm AS f0, a.alarm AS f1, b.alarm AS f2, c.alarm AS f3, n.board, round(greatest(n.value, a.value, coalesce(b.value, 0), coalesce(c.value, 0)) / 20, 9) AS score
FROM (SELECT event_id, alarm, board, value, e1, NULL AS e2, NULL AS e3 FROM next_events UNION ALL SELECT event_id, alarm, board, value, e1, e2, NULL FROM next_events WHERE e2 IS NOT NULL UNION ALL SELECT event_id, alarm, board, value, e1, e2, e3 FROM next_events WHERE e3 IS NOT NULL) n
JOIN ev a ON a.event_id = n.e1 LEFT JOIN ev b ON b.event_id = n.e2 LEFT JOIN ev c ON c.event_id = n.e3""",
)


@add(
    "chain_classes",
    sql(
        """WITH g AS (SELECT *, CASE WHEN score > 0.8 THEN 1 ELSE 0 END AS gt FROM echains), k AS (SELECT DISTINCT coalesce(f0, '-') || coalesce(f1, '-') || coalesce(f2, '-') || coalesce(f3, '-') AS f FROM g WHERE gt = 1 AND board % 7 = 0)
SELECT h0, h1, h2, h3, gt, score, CASE WHEN h2 IS NULL THEN 1 WHEN h3 IS NULL THEN 2 ELSE 3 END AS n_hops FROM g WHERE score > 0.5 AND coalesce(f0, '-') || coalesce(f1, '-') || coalesce(f2, '-') || coalesce(f3, '-') IN (SELECT f FROM k)""",
        "echains",
    ),
)
def chain_classes(s, d):
    e = B.events(s, d)
    order = W.partitionBy("board").orderBy("ts", "event_id")
    ends = [F.col(c).alias(f"src_{c}") for c in ("alarm", "value")] + [F.lead(c).over(order).alias(f"dst_{c}") for c in ("alarm", "value")]
    links = materialise(e.select("board", F.col("event_id").alias("src"), F.lead("event_id").over(order).alias("dst"), *ends).filter("dst is not null"), "event-links")
    parts = max(math.ceil(links.count() / LINKS_A_TASK), int(s.conf.get("spark.sql.shuffle.partitions")))
    c = C.hop_chains(links, with_={"alarm": "f", "value": "v"}, keep=("board",), parts=parts)
    score = F.round(F.greatest(*[F.coalesce(f"v{i}", F.lit(0)) for i in range(4)]) / 20, 9)
    c = c.withColumn("score", score).withColumn("gt", F.when(F.col("score") > 0.8, 1).otherwise(0))
    return C.filter_chains(c, c.filter("board % 7 = 0"), ["f0", "f1", "f2", "f3"])


# Trails: orders and regions are stops, customers and nations lie between.

B.CTES["tree_links"] = ((), "SELECT o_orderkey * 4 AS src, o_custkey * 4 + 1 AS dst FROM orders UNION SELECT c_custkey * 4 + 1, c_nationkey * 4 + 2 FROM customer UNION SELECT n_nationkey * 4 + 2, n_regionkey * 4 + 3 FROM nation")


@add(
    "constrained_trails",
    sql(
        """WITH e AS (SELECT src AS a, dst AS b FROM tree_links UNION SELECT dst, src FROM tree_links), r AS (SELECT v AS root, v AS place, [v] AS trail FROM (SELECT a AS v FROM e WHERE a % 4 IN (0, 3) GROUP BY a)
UNION ALL SELECT root, b, list_append(trail, b) FROM r JOIN e ON e.a = r.place WHERE len(trail) <= 3 AND (len(trail) = 1 OR place % 4 IN (1, 2)) AND NOT list_contains(trail, b))
SELECT root AS a, place AS b, (min(len(trail)) - 1)::INT AS steps, arg_min(trail, (len(trail), trail)) AS trail FROM r WHERE place % 4 IN (0, 3) AND root < place GROUP BY root, place""",
        "tree_links",
        recursive=True,
    ),
)
def constrained_trails(s, d):
    o, c, n = (B.table(s, d, t) for t in ("orders", "customer", "nation"))
    of = lambda df, a, i, b, j: df.select((F.col(a) * 4 + i).cast("long").alias("src"), (F.col(b) * 4 + j).cast("long").alias("dst"))
    e = of(o, "o_orderkey", 0, "o_custkey", 1).unionByName(of(c, "c_custkey", 1, "c_nationkey", 2)).unionByName(of(n, "n_nationkey", 2, "n_regionkey", 3))
    v = e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().withColumn("stop", (F.col("v") % 4).isin(0, 3))
    return C.constrained_trails(e, v, materialise, 3, links=materialise(C.trail_links(e, v), "trail-links"))


# Legacy tokens: electrical hops are endpoint tokens, optical ones muxes and others of side 1 or 2.

_TOKEN = "'ROADM' || node || '-' || CASE WHEN kind IN ('TRIB', 'XCON', 'LINE') THEN 'OTU' || board WHEN kind IN ('OM', 'OD') THEN kind || (board % 3) ELSE kind END || CASE WHEN board % 5 > 0 THEN '$' || (board % 5) ELSE '' END"
B.CTES["tokens"] = (("hops",), f"SELECT path_id, pos, {_TOKEN} AS t, lead({_TOKEN}) OVER (PARTITION BY path_id ORDER BY pos) AS n, lag({_TOKEN}) OVER (PARTITION BY path_id ORDER BY pos) AS p FROM hops")
_SIDE = "CASE WHEN n LIKE '%-OM2%' OR n LIKE '%-OD2%' THEN '2' WHEN n LIKE '%-OM1%' OR n LIKE '%-OD1%' THEN '1' WHEN p LIKE '%-OM2%' OR p LIKE '%-OD2%' THEN '2' ELSE '1' END"
_STRICT = "CASE WHEN n LIKE '%OM2%' THEN '2' WHEN n LIKE '%OM1%' THEN '1' WHEN p LIKE '%OD2%' THEN '2' ELSE '1' END"


@add(
    "legacy_tokens",
    sql(
        f"""SELECT path_id, string_agg(CASE WHEN t LIKE '%-OTU%' THEN split_part(t, '-', 1) || '-Line' || {_SIDE} || '$' || CASE WHEN t LIKE '%$%' THEN split_part(t, '$', -1) ELSE '0' END ELSE t END, ',' ORDER BY pos) AS boards,
string_agg(CASE WHEN t LIKE '%-OTU%' THEN split_part(t, '-', 1) || '-Line' || {_STRICT} || '$0' ELSE t END, ',' ORDER BY pos) AS strict FROM tokens GROUP BY path_id""",
        "tokens",
    ),
)
def legacy_tokens(s, d):
    board = F.col("board")
    name = F.when(F.col("kind").isin("TRIB", "XCON", "LINE"), F.concat(F.lit("OTU"), board.cast("string"))).when(F.col("kind").isin("OM", "OD"), F.concat("kind", (board % 3).cast("string"))).otherwise(F.col("kind"))
    token = F.concat(F.lit("ROADM"), F.col("node").cast("string"), F.lit("-"), name, F.when(board % 5 > 0, F.concat(F.lit("$"), (board % 5).cast("string"))).otherwise(""))
    paths = B.hops(s, d).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", token.alias("t")))).alias("x")).select("path_id", F.transform("x", lambda t: t["t"]).alias("tokens"))
    join = lambda c: F.array_join(c, ",")
    return paths.select("path_id", join(C.translate_tokens(F.col("tokens"))).alias("boards"), join(C.translate_tokens(F.col("tokens"), C.STRICT_SIDES, keep_copy=False)).alias("strict"))


# Training logs: a customer's orders are a run's entries, written as one object or as lines, under different names.

_RUN = "o_custkey % 4"


@add(
    "training_logs",
    f"""WITH e AS (SELECT o_custkey AS run, o_orderkey AS step, CASE WHEN o_orderkey % 3 = 0 OR {_RUN} = 3 THEN NULL ELSE o_totalprice END AS reward, CASE WHEN o_orderkey % 5 = 0 OR {_RUN} = 3 THEN NULL ELSE o_orderkey % 5 + 0.5 END AS loss FROM orders WHERE o_orderkey % 11 > 0)
SELECT run, step, reward, loss FROM e WHERE run IN (SELECT run FROM e WHERE reward IS NOT NULL OR loss IS NOT NULL)""",
)
def training_logs(s, d):
    k, run = F.col("o_orderkey"), F.col("o_custkey") % 4
    o = B.table(s, d, "orders")
    step = F.when(k % 11 > 0, k)
    reward = F.when((k % 3 > 0) & (run < 3), F.col("o_totalprice"))
    loss = F.when((k % 5 > 0) & (run < 3), k % 5 + 0.5)
    named = F.when(run == 0, F.to_json(F.struct(step.alias("step"), reward.alias("reward"), loss.alias("loss")))).when(run == 1, F.to_json(F.struct(step.alias("global_step"), F.lit(0.0).alias("reward"), reward.alias("reward_mean"), loss.alias("train_loss"))))
    named = named.otherwise(F.to_json(F.struct(step.alias("step"), reward.alias("mean_reward"), loss.alias("loss"))))
    entries = o.groupBy(F.col("o_custkey").alias("run")).agg(F.collect_list(named).alias("x"))
    whole = F.concat(F.lit('{"best": 1, "log_history": ['), F.array_join("x", ", "), F.lit("]}"))
    lines = F.concat(F.lit("# log\n"), F.array_join("x", "\n"), F.lit("\n{broken"))
    return E.training_logs(entries.select("run", F.when(F.col("run") % 4 == 0, whole).otherwise(lines).alias("content")))
