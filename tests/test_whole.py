"""Queries over the whole input, on tables small enough to check by hand."""

import datetime

import pytest

from lumentrace.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Boards 1..40, one node each; paths 1-2-3 and 30-31; board 31 fails."""
    d = str(tmp_path_factory.mktemp("whole"))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    save([(i, i) for i in range(1, 41)], "s_suppkey long, s_nationkey long", "supplier")
    save([(i, 0) for i in range(1, 41)], "n_nationkey long, n_regionkey long", "nation")
    lines = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 30), (2, 2, 31)]
    save([(o, n, 1, b) for o, n, b in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", "lineitem")
    at = datetime.datetime(2024, 1, 1)
    events = [(k, at + datetime.timedelta(seconds=k), 31, "error" if k == 0 else "view", 1.0) for k in range(9)]
    save(events, "event_id long, ts timestamp, user_id long, event_type string, value double", "events")
    return d


def rows(spark, tables, name):
    return {tuple(r) for r in registry.queries()[name](spark, tables).collect()}


def test_topology_takes_all_edges_and_boards(spark, tables):
    parts = {b: b for b in range(1, 41)} | {2: 1, 3: 1, 31: 30}
    assert rows(spark, tables, "connected_components") == set(parts.items())
    near = {(b, b, 0) for b in range(1, 41)} | {(a, b, abs(a - b)) for a in (1, 2, 3) for b in (1, 2, 3)} | {(30, 31, 1), (31, 30, 1)}
    assert rows(spark, tables, "khop_region") == near
    assert rows(spark, tables, "bounded_shortest_path") == {(a, b, abs(a - b)) for a in (1, 2, 3) for b in (1, 2, 3) if a != b} | {(30, 31, 1), (31, 30, 1)}
    assert rows(spark, tables, "upstream_downstream_sets") == {(31, "up", 1, 30)}


def test_parts_of_path_windows_follow_the_lines(spark, tables, monkeypatch):
    """With two lines a task, five lines are dealt by path in as many parts as that takes, and the rows stay the same."""
    from lumentrace.plans import bindings as B

    before = {n: rows(spark, tables, n) for n in ("path_hops", "nearest_of_type")}
    monkeypatch.setattr(B, "LINES_A_TASK", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert B.path_parts(spark, tables) == 3 and B.hops(spark, tables).rdd.getNumPartitions() == 3
        assert {n: rows(spark, tables, n) for n in before} == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
