"""Walks within cells against walks level by level, on networks of several parts."""

import random

import pytest
from pyspark.sql import functions as F

from lumentrace.operators import cells as C
from lumentrace.operators import flows as W
from lumentrace.operators import propagation as P
from lumentrace.operators import topology as T
from lumentrace.plans import bindings as B
from lumentrace.sources.storage import materialise

REACT = "board long, from_alarm string, to_board long, to_alarm string, rule_idx int, direction string, edge_type string"


@pytest.fixture(scope="module")
def network(spark):
    """Four parts of boards far from 0, seeds in each, alarms that nothing reacts to, and a board without reactions."""
    rng, rows, seeds = random.Random(8), [], []
    for part in range(4):
        at = lambda: 10**10 + 100 * part + rng.randrange(9)  # noqa: B023, E731
        rows += [(at(), rng.choice("abc"), at(), "abcab"[rule], rule, *rng.choice([("", ""), ("D", "regen_boundary"), ("U", "x"), ("D", "y")])) for rule in [rng.randrange(5) for _ in range(60)]]
        seeds += [(7 * i + part, at(), rng.choice("abcd"), 1000 + rng.choice((0, 1, 4, 40, 400)) + rng.randrange(3), i + 0.5) for i in range(9)]
    rows = [r for i, r in enumerate(rows) if all(r[:5] != q[:5] for q in rows[:i])]
    seeds += [(500, 7, "a", 1001, 1.0), (501, 7, "a", 1001, 2.0)]
    return spark.createDataFrame(rows, REACT), spark.createDataFrame(seeds, "id long, board long, event string, start_s long, duration_s double")


def lines(df, *by):
    return sorted(map(str, df.select(*(by or df.columns)).collect()))


@pytest.mark.parametrize("a_cell", [10**6, 70])
def test_walks_in_cells_equal_those_by_level(spark, network, monkeypatch, a_cell):
    """One cell, some parts a cell and a part each; a hop exchanged and wrote a level before, all hops write one table now."""
    react, starts = network
    monkeypatch.setattr(C, "A_CELL", a_cell)
    seeds = spark.createDataFrame([(r["id"] * 100 + i, r["board"], r["event"]) for r in starts.collect() for i in range(4)], "root long, board long, alarm string")
    tags = []
    got = P.propagate_in_cells(seeds, react, 4, lambda df, tag: tags.append(tag) or materialise(df, tag))
    assert lines(got) == lines(P.propagate(seeds, react, 4, materialise)) and tags.count("flow") == 1
    walked, roots = P.walk_in_cells(seeds, react, 4, materialise)
    assert lines(P.summary_of_walk(walked, roots)) == lines(P.summary_of_walk(*P.walk(seeds, react, 4, materialise)))
    tags.clear()
    timed = P.timed_in_cells(seeds, react, 4, 4, lambda df, tag: tags.append(tag) or materialise(df, tag))
    assert lines(timed) == lines(P.timed(seeds, react, 4, 4, materialise)) and "flow" not in tags


@pytest.mark.parametrize(("a_cell", "cover", "per_root"), [(10**6, 8, False), (70, 0.1, False), (1, 0.1, True)])
def test_flows_in_cells_equal_those_by_level(network, monkeypatch, a_cell, cover, per_root):
    """A level was joined, exchanged and written a few times before."""
    react, starts = network
    monkeypatch.setattr(C, "A_CELL", a_cell)
    want = materialise(W.alarm_flow(starts, react, materialise, per_root=per_root), "want")
    monkeypatch.setattr(W, "COVER", cover)
    tags = []
    got = W.flow_in_cells(starts, react, lambda df, tag: tags.append(tag) or materialise(df, tag), per_root=per_root)
    assert got.dtypes == want.dtypes and lines(got) == lines(want) and not {"alarm-flow", "flow-best"} & set(tags)
    brief = W.flow_in_cells(starts, react, materialise, per_root=per_root, brief=True)
    assert lines(brief) == lines(want, *brief.columns)


def test_regions_in_cells_equal_those_by_level(spark, monkeypatch):
    """Every level exchanged all boards' masks before; a root alone, one given twice and loops among them."""
    rng = random.Random(10)
    links = spark.createDataFrame(sorted({(100 * p + rng.randrange(40), 100 * p + rng.randrange(40)) for p in range(4) for _ in range(45)}), "src long, dst long")
    roots = spark.createDataFrame([(100 * p + i,) for p in range(4) for i in range(40)] + [(999,), (0,)], "board long")
    want = lines(T.khop_region(links, roots, 2, materialise))
    for a_cell in (10**6, 50):
        monkeypatch.setattr(C, "A_CELL", a_cell)
        tags = []
        assert lines(P.khop_in_cells(links, roots, 2, lambda df, tag: tags.append(tag) or materialise(df, tag))) == want and "khop" not in tags  # noqa: B023
    monkeypatch.setattr(C, "MAX_PART", 5)
    assert lines(P.khop_in_cells(links, roots, 2, materialise)) == want


def test_large_parts_and_places_go_by_level(spark, network, monkeypatch):
    """Parts beyond a task, and queues beyond a number, give the same rows level by level. Ranks of the latter put waiting before the board led to."""
    react, starts = network
    want = lines(W.flow_in_cells(starts, react, materialise))
    seeds = starts.select(F.col("id").alias("root"), "board", F.col("event").alias("alarm"))
    walks = lines(P.propagate_in_cells(seeds, react, 2, materialise)), lines(P.timed_in_cells(seeds, react, 2, 4, materialise))
    tags = []
    kept = lambda df, tag: tags.append(tag) or materialise(df, tag)
    monkeypatch.setattr(W, "MAX_PLACE", 1)
    assert lines(W.flow_in_cells(starts, react, kept)) == want and "alarm-flow" in tags
    monkeypatch.undo()
    monkeypatch.setattr(C, "MAX_PART", 10)
    tags.clear()
    assert C.deal(react, starts.select("board", F.col("event").alias("alarm"), F.col("id").alias("n"), F.col("start_s").alias("at"), F.col("duration_s").alias("lasts")), ["from_alarm", "to_alarm"], None, materialise) is None
    assert (lines(P.propagate_in_cells(seeds, react, 2, kept)), lines(P.timed_in_cells(seeds, react, 2, 4, kept))) == walks and tags.count("flow") == 5
    assert lines(P.propagate_in_cells(seeds, react.filter("false"), 2, materialise)) == lines(P.propagate(seeds, react.filter("false"), 2, materialise))


def test_reactions_are_made_of_what_is_asked_for(spark):
    """Nearest boards were looked up for all types both ways, and boundaries took a second exchange of all hops; all reactions were made distinct."""
    rng = random.Random(9)
    kinds = [rng.choice(B.KINDS) for _ in range(25)]
    paths = [rng.sample(range(25), rng.randrange(1, 10)) for _ in range(30)] + [[b for b in range(25) if kinds[b] in ("REGENIN", "REGENOUT")]]
    hops = [(p, i + 1, len(path), b, b % 3, 0, kinds[b], "SRC" if i == 0 else "TERMINATION" if i == len(path) - 1 else "") for p, path in enumerate(paths) for i, b in enumerate(path)]
    hops = spark.createDataFrame(hops, "path_id long, pos int, n int, board long, node int, domain int, kind string, role string")
    rules = B.rules(spark)
    typed = T.typed_boards(hops.select("board", "node", "domain", "kind").distinct(), hops)
    wanted = P.asked_for(rules)
    every, some = T.nearest_of_type(hops, typed, sectioned=True), T.nearest_of_type(hops, typed, sectioned=True, wanted=wanted)
    ftype = {r["board"]: r["ftype"] for r in typed.collect()}
    assert lines(some) == sorted(str(r) for r in every.collect() if (ftype[r["board"]], r["direction"], r["to_type"]) in wanted)
    assert 0 < some.count() < every.count() and T.nearest_of_type(hops, typed, sectioned=True, wanted=set()).count() == 0
    over = T.boundaries(T.with_boundary(hops))
    assert lines(over) == lines(T.adjacency(hops).filter("edge_type = 'regen_boundary' and direction = 'D'"))
    react = P.reactions(rules, typed, some, over)
    assert lines(react) == lines(react.distinct()) == lines(P.reactions(rules, typed, every, T.adjacency(hops)).distinct())
