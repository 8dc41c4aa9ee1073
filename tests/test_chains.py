"""Regions, chains, trails, tokens, logs and fixed-point text against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumentrace.functions import scalars as S
from lumentrace.operators import chains as C
from lumentrace.operators import evaluation as E
from lumentrace.sources.storage import materialise


def graph(rng, n, m):
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def neighbours(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def reach(near, root):
    seen, todo = {root}, [root]
    while todo:
        for x in near.get(todo.pop(), ()):
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def test_regions_hold_their_quota_and_are_connected(spark):
    rng = random.Random(1)
    edges = graph(rng, 60, 55)
    near = neighbours(edges)
    quota = {r: k for r, k in zip(range(62), [1, 2, 3, 5, 8, 13, 40, 0] * 8, strict=False)}
    roots = spark.createDataFrame([*quota.items(), (3, 2), (None, 4)], "root long, k long")
    rows = C.connected_regions(spark.createDataFrame(edges, "src long, dst long"), roots, materialise, 4).collect()
    got = {}
    for r in rows:
        got.setdefault(r["root"], {})[r["board"]] = r["hop"]
    assert len(rows) == sum(map(len, got.values())) and set(got) == set(quota)
    for root, region in got.items():
        whole = reach(near, root)
        assert len(region) == min(max(1, quota[root]), len(whole)) and region[root] == 0
        for board, hop in region.items():
            assert hop == 0 or any(region.get(x) == hop - 1 for x in near[board])
    again = C.connected_regions(spark.createDataFrame(edges, "src long, dst long").repartition(5), roots, materialise, 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert C.connected_regions(spark.createDataFrame([], "src long, dst long"), roots.limit(0), materialise).count() == 0


def test_regions_exchange_what_a_root_can_take_and_that_once(spark):
    plans = []

    def kept(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, tag)

    hub = spark.range(1, 400).selectExpr("0L AS src", "id AS dst")
    roots = spark.range(0, 400).selectExpr("id AS root", "4L AS k")
    rows = C.connected_regions(hub, roots, kept, 4)
    assert rows.count() == 1600 and rows.distinct().count() == 1600
    # A level has one exchange of candidates, by root, and cuts them by root and neighbour before it.
    for plan in plans[1:]:
        assert plan.count("Exchange hashpartitioning(root") == 1 and "Exchange hashpartitioning(board" not in plan
        assert plan.index("Exchange hashpartitioning(root") < plan.index("WindowGroupLimit [root", plan.index("Exchange hashpartitioning(root"))


def test_chains_and_classes(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (2, 9)]
    got = sorted(C.hop_chains(spark.createDataFrame(links, "src long, dst long")).collect(), key=str)
    two = [(1, 2, 3), (2, 3, 4), (3, 4, 5), (1, 2, 9)]
    three = [(1, 2, 3, 4), (2, 3, 4, 5)]
    assert [tuple(r) for r in got] == sorted([(*x, None, None) for x in links] + [(*x, None) for x in two] + three, key=str)
    places = [(1, 2, None, None), (1, 2, 3, None), (1, 2, 3, 4), (1, None, 3, None), (None, 2, None, None), (1, None, None, None), (1, 2, None, 4)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, h0 int, h1 int, h2 int, h3 int")
    assert [r[0] for r in df.orderBy("i").select(C.chain_class(*[F.col(f"h{i}") for i in range(4)])).collect()] == [1, 2, 3, None, None, None, None]


def test_filter_chains_keeps_known_features(spark):
    schema = "h0 int, h1 int, h2 int, h3 int, gt int, score double, fa string, fb string"
    training = spark.createDataFrame([(1, 2, None, None, 1, 0.1, "x", None), (1, 2, 3, None, 0, 0.9, "y", "z"), (1, 2, 3, 4, 1, 0.9, None, None)], schema)
    rows = [(1, 2, None, None, 0, 0.6, "x", None), (1, 2, 3, None, 1, 0.7, "x", None), (1, 2, 3, None, 1, 0.7, "y", "z"), (5, 6, 7, 8, 0, 0.51, None, None), (5, 6, None, None, 0, 0.5, "x", None), (5, None, 7, None, 0, 0.9, "x", None), (5, 6, None, None, 1, None, "x", None)]
    got = C.filter_chains(spark.createDataFrame(rows, schema), training, ["fa", "fb"]).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(1, 2, None, None, 0, 0.6, 1), (1, 2, 3, None, 1, 0.7, 2), (5, 6, 7, 8, 0, 0.51, 3)], key=str)


def test_trails_pass_no_stop(spark):
    rng = random.Random(2)
    edges = graph(rng, 40, 70)
    near = neighbours(edges)
    stop = {v: rng.random() < 0.4 for v in range(40)}
    want = {}
    for root in (v for v in stop if stop[v]):
        level = {root: (root,)}
        seen = {root}
        for _ in range(4):
            nxt = {}
            for v, trail in level.items():
                if v == root or not stop[v]:
                    for x in near.get(v, ()):
                        if x not in seen:
                            nxt[x] = min(nxt.get(x, (99,)), (*trail, x))
            seen |= set(nxt)
            want.update({(root, v): list(t) for v, t in nxt.items() if stop[v] and root < v})
            level = nxt
    v = spark.createDataFrame(list(stop.items()), "v long, stop boolean")
    got = {(r["a"], r["b"]): r for r in C.constrained_trails(spark.createDataFrame(edges, "src long, dst long"), v, materialise, 4).collect()}
    assert {k: r["trail"] for k, r in got.items()} == want and len(want) > 20
    assert all(r["steps"] == len(r["trail"]) - 1 and not any(stop[x] for x in r["trail"][1:-1]) for r in got.values())
    assert C.constrained_trails(spark.createDataFrame([], "src long, dst long"), v, materialise, 4).count() == 0


def test_last_step_of_trails_keeps_stops_only(spark):
    """A hub with many vertices that are no stops: the last level must not hold every root with all of them."""
    hub, roots, others = 1000, 20, 200
    edges = [(r, 100 + r) for r in range(roots)] + [(100 + r, hub) for r in range(roots)] + [(hub, 2000 + i) for i in range(others)]
    v = spark.createDataFrame([(x, x < roots) for x in {x for e in edges for x in e}], "v long, stop boolean")
    levels = []

    def kept(df, tag):
        out = materialise(df, tag)
        levels.append(out.count())
        return out

    assert C.constrained_trails(spark.createDataFrame(edges, "src long, dst long"), v, kept, 3).count() == 0
    assert levels == [roots, roots, 0]
    got = C.constrained_trails(spark.createDataFrame(edges, "src long, dst long"), v, kept, 4)
    assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a in range(roots) for b in range(a + 1, roots)}


def test_levels_of_trails_leave_out_smaller_stops(spark):
    """A level held each root's trails to smaller stops too, whole, and was exchanged by root and place after it was by root, place and kind."""
    roots = 12
    edges = [(r, 100) for r in range(roots)] + [(r, 101) for r in range(roots)] + [(100, 102), (102, 200)]
    v = spark.createDataFrame([(x, x < roots or x == 200) for x in {x for e in edges for x in e}], "v long, stop boolean")
    levels, plans = [], []

    def kept(df, tag):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        levels.append(materialise(df, tag))
        return levels[-1]

    df = spark.createDataFrame(edges, "src long, dst long")
    got = {(r["a"], r["b"]): (r["steps"], r["trail"]) for r in C.constrained_trails(df, v, kept, 3, links=materialise(C.trail_links(df, v), "links")).collect()}
    want = {(a, b): (2, [a, 100, b]) for a in range(roots) for b in range(a + 1, roots)} | {(a, 200): (3, [a, 100, 102, 200]) for a in range(roots)}
    assert got == want
    assert not any(t.filter("stop and at < root").count() for t in levels) and not any("LeftAnti" in p for p in plans)


def test_legacy_tokens(spark):
    rows = [
        (1, ["R1-OTU3$2", "R1-OM2$0", "R1-OTU4"]),
        (2, ["R1-OTU3", "R1-OA1$0", "R2-OD1$0", "R2-OTU1$5"]),
        (3, ["R1-OTU1", "R1-OTU2"]),
        (4, ["R1-OM1$0", "R1-OTU2$1", "R1-OM2$0"]),
        (5, []),
        (6, None),
    ]
    df = spark.createDataFrame(rows, "i int, t array<string>").orderBy("i")
    one = [r[0] for r in df.select(C.translate_tokens(F.col("t"))).collect()]
    assert one == [["R1-Line2$2", "R1-OM2$0", "R1-Line2$0"], ["R1-Line1$0", "R1-OA1$0", "R2-OD1$0", "R2-Line1$5"], ["R1-Line1$0", "R1-Line1$0"], ["R1-OM1$0", "R1-Line2$1", "R1-OM2$0"], [], None]
    other = [r[0] for r in df.select(C.translate_tokens(F.col("t"), C.STRICT_SIDES, keep_copy=False)).collect()]
    assert other == [["R1-Line2$0", "R1-OM2$0", "R1-Line1$0"], ["R1-Line1$0", "R1-OA1$0", "R2-OD1$0", "R2-Line1$0"], ["R1-Line1$0", "R1-Line1$0"], ["R1-OM1$0", "R1-Line2$0", "R1-OM2$0"], [], None]


def test_training_logs(spark):
    entries = [{"step": 1, "reward": 0.5}, {"global_step": 2, "reward": 0, "reward_mean": 0.25, "loss": 1}, {"step": None, "loss": 4}, {"step": 3, "mean_reward": 0, "train_loss": 2.5}, {"step": 4, "loss": None, "train_loss": 7}, {"note": "x"}]
    files = [("nested", json.dumps({"log_history": entries})), ("lines", "\n".join(["# head", *map(json.dumps, entries), "{oops", ""])), ("empty", ""), ("none", None), ("bare", json.dumps({"log_history": [{"step": 1}]})), ("odd", json.dumps({"other": 3}))]
    got = sorted(map(tuple, E.training_logs(spark.createDataFrame(files, "run string, content string")).collect()), key=str)
    one = [(1, 0.5, None), (2, 0.25, 1.0), (3, 0.0, 2.5), (4, None, None)]
    assert got == sorted([(run, *r) for run in ("nested", "lines") for r in one], key=str)


@pytest.mark.parametrize("digits", [0, 2, 4])
def test_fixed_rounds_the_binary_value(spark, digits):
    rng = random.Random(digits)
    values = [k / 32 for k in range(-70, 70)] + [1.00005, 2.675, 0.00005, 0.15, 0.25, -0.0, 0.0, 1e-9, -1e-9, 12345.00005, 99999.99995, 5e-324, 1e7 + 0.5] + [rng.uniform(-3, 3) for _ in range(300)] + [round(rng.uniform(0, 2), digits) + 0.5 / 10**digits for _ in range(300)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(S.fixed(F.col("v"), digits)).collect()]
    assert got == [f"{v:.{digits}f}" for v in values]


def test_chains_take_along_what_their_places_hold(spark):
    """What lies at a place was looked up by four joins afterwards; a link's ends now carry it."""
    rows = [(i, i + 1, f"a{i}", f"a{i + 1}", i // 10) for i in range(6)]
    df = spark.createDataFrame(rows, "src long, dst long, src_alarm string, dst_alarm string, board long")
    got = C.hop_chains(df, with_={"alarm": "f"}, keep=("board",), parts=3).collect()
    assert len(got) == 6 + 5 + 4
    for r in got:
        assert [r[f"f{i}"] for i in range(4)] == [None if r[f"h{i}"] is None else f"a{r[f'h{i}']}" for i in range(4)] and r["board"] == 0
    from lumentrace.plans import registry

    plan = registry.queries()["chain_classes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan


def test_first_roles_count_services_once(spark):
    """A relay that a service passes twice counts once, and no pair of function and service is exchanged to be counted."""
    from lumentrace.operators import networks as N

    rows = [(2, 1, 0, 7, "SRC", "src:7:2"), (2, 1, 1, 7, "RELAY_OUT", "out:7:s"), (2, 3, 0, 7, "RELAY_OUT", "out:7:s"), (1, 4, 1, 7, "RELAY_X", "out:7:s"), (1, 5, 0, 8, "SNK", "snk:8:1")]
    df = spark.createDataFrame(rows, "path_id long, step int, k int, node long, role string, id string")
    want = [("out:7:s", "RELAY_X", 7, 1, 2), ("snk:8:1", "SNK", 8, 1, 1), ("src:7:2", "SRC", 7, 2, 1)]
    for parts in (None, 3):
        out = N.first_roles(df, parts)
        assert sorted(map(tuple, out.collect())) == want
        assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString()
