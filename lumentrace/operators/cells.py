"""Walks over reactions within cells: seeds meet all reactions of their connected part in one task, so that no hop is exchanged.

What happens in one connected part of the boards never reaches another. So parts are dealt to cells, each reaction once a cell, and all hops
of a cell's seeds run where they lie. A part of more than ``MAX_PART`` reactions is no task's work: then ``deal`` gives nothing, and callers
go level by level with exchanges instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import topology as T
from .preparation import ranked

#: Reactions of one connected part up to which one task holds them, and of several parts that share a cell.
MAX_PART, A_CELL = 4_000_000, 1_000_000
#: Kinds of reactions and names of alarms that the tasks are told beforehand, boards whose cells are broadcast, reactions copied to seed cells in all.
MAX_KINDS, MAX_BOARDS, MAX_COPIED = 100_000, 500_000, 16_000_000
#: Numbers that a task looks at in one go.
AT_ONCE = 16_000_000


class Dealt:
    """Seeds and reactions by cell, with what their codes mean."""

    def __init__(self, rows: DataFrame, cells: int, names: list[str], kinds: list, boards: int, seeds: int):
        self.rows, self.cells, self.names, self.kinds, self.boards, self.seeds = rows, cells, names, kinds, boards, seeds

    def run(self, walk: Callable, schema: str) -> DataFrame:
        """``walk(part, names, kinds)`` for every connected part of a cell: batches of rows."""
        names, kinds = self.names, self.kinds

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                yield from walk(part, names, kinds)

        return self.rows.repartitionById(self.cells, F.col("cell")).drop("cell").mapInArrow(each, schema)


def deal(react: DataFrame, seeds: DataFrame, kind: list[str], apart: Callable | None, materialise, most: int | None = None) -> Dealt | None:
    """``seeds`` (board, alarm, n, at, lasts: numbers as the walk reads them) and reactions, dealt; nothing if a part has more than ``most`` reactions.

    ``kind``: what tells reactions apart besides their boards. Where cells are fewer than the session's cores can use, ``apart`` adds a number
    of that name to the seeds (a, b, at) of a cell: seeds that differ in it need not lie together, and go to copies of the cell.
    """
    most = MAX_PART if most is None else most
    spark, n = react.sparkSession, react.count()
    kinds = react.select(*kind).distinct().limit(MAX_KINDS + 1).collect()
    alarms = seeds.select("alarm").distinct().limit(MAX_KINDS + 1).collect()
    if len(kinds) + len(alarms) > MAX_KINDS:
        return None
    names = sorted({r[c] for r in kinds for c in ("from_alarm", "to_alarm")} | {r["alarm"] for r in alarms})
    schema = react.select(*kind).schema.add("code", "integer")
    known = spark.createDataFrame(pa.table({c: [(*r, i)[j] for i, r in enumerate(kinds)] for j, c in enumerate((*kind, "code"))}), schema)
    named = spark.createDataFrame(pa.table({"alarm": pa.array(names, pa.string()), "code": [-1 - i for i in range(len(names))]}), "alarm string, code int")
    edges = react.join(F.broadcast(known), [react[c].eqNullSafe(known[c]) for c in kind]).select(react["board"].alias("a"), react["to_board"].alias("b"), "code")
    starts = seeds.join(F.broadcast(named), "alarm").select(F.col("board").alias("a"), F.col("n").alias("b"), "code", "at", "lasts")
    if n <= min(A_CELL, most):
        cells, size, part = 1, None, {"cell": F.lit(0), "part": F.lit(0).cast("long")}
        edges, starts = edges.withColumns(part), starts.withColumns(part)
        boards = react.select("board").unionByName(react.select(F.col("to_board").alias("board"))).unionByName(seeds.select("board")).distinct().count()
    else:
        every = react.select("board").unionByName(react.select(F.col("to_board").alias("board"))).unionByName(seeds.select("board")).distinct()
        part = T.connected_components(react.select(F.col("board").alias("src"), F.col("to_board").alias("dst")), materialise(every, "cell-boards"), materialise)
        small = lambda df: F.broadcast(df) if df.count() <= MAX_BOARDS else df
        of = react.groupBy("board").agg(F.count(F.lit(1)).alias("n"))
        size = materialise(part.join(of, "board", "left").groupBy("component").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("boards")), "cell-parts")
        top = size.agg(F.max("n").alias("n"), F.max("boards").alias("boards")).first()
        if top["n"] > most:
            return None
        boards = top["boards"]
        # Parts in order, each where the sum of those up to it falls; a part without reactions weighs as one.
        upto = ranked(size.withColumn("n", F.greatest("n", F.lit(1))), F.col("component"), of=F.col("n"), name="upto")
        cell = materialise(part.join(upto.select("component", F.floor((F.col("upto") - 1) / A_CELL).cast("int").alias("cell")), "component").select(F.col("board").alias("a"), F.col("component").alias("part"), "cell"), "cells")
        cells = cell.agg(F.max("cell")).first()[0] + 1
        edges, starts = edges.join(small(cell), "a"), starts.join(small(cell), "a")
    copies = 1 if apart is None else max(1, min(math.ceil(spark.sparkContext.defaultParallelism * 2 / cells), MAX_COPIED // max(1, n)))
    starts = materialise(starts.withColumn("apart", F.lit(0)) if apart is None else apart(starts), "cell-seeds")
    per_part = starts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    starts = starts.withColumn("cell", F.col("cell") * copies + F.pmod("apart", F.lit(copies)).cast("int"))
    if copies > 1:
        edges = edges.withColumn("cell", F.explode(F.sequence(F.col("cell") * copies, F.col("cell") * copies + copies - 1)))
    cols = ["cell", "part", "a", "b", "code", "at", "lasts"]
    rows = edges.withColumns({"at": F.lit(None).cast("long"), "lasts": F.lit(None).cast("double")}).select(*cols).unionByName(starts.select(*cols))
    return Dealt(rows, cells * copies, names, [tuple(r) for r in kinds], boards, per_part)


class Part:
    """A connected part: boards in order, states (a board with an alarm), reactions between them and seeds, all numbered."""

    def __init__(self, edges, seeds, names, froms, tos):
        a, b, code = edges
        self.seed_board, self.seed_n, alarm, self.seed_at, self.seed_lasts = seeds
        self.boards = np.unique(np.concatenate([a, b, self.seed_board]))
        n, place = len(names), lambda x: np.searchsorted(self.boards, x)
        keys = [place(a) * n + froms[code], place(b) * n + tos[code], place(self.seed_board) * n + alarm]
        states = np.unique(np.concatenate(keys))
        self.from_, self.to, self.seed = (np.searchsorted(states, k).astype(np.int32) for k in keys)
        self.code, self.size = code, len(states)
        self.board, self.alarm = states // n, states % n


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Reactions (a, b, code) and seeds (a, b, alarm, at, lasts) of each connected part that has seeds."""
    edges, seeds = [], []
    for x in batches:
        part, a, b, code, at = (x.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("part", "a", "b", "code", "at"))
        is_edge = code >= 0
        edges.append([v[is_edge] for v in (part, a, b, code)])
        lasts = x.column("lasts").fill_null(0.0).to_numpy(zero_copy_only=False)
        seeds.append([v[~is_edge] for v in (part, a, b, -1 - code, at, lasts)])
    if not edges:
        return
    edges, seeds = [np.concatenate(v) for v in zip(*edges, strict=True)], [np.concatenate(v) for v in zip(*seeds, strict=True)]
    found = np.unique(seeds[0])
    edges, seeds = ([v[o] for v in t] for t in (edges, seeds) for o in [np.argsort(t[0], kind="stable")])
    for p in found:
        (i, j), (k, m) = (np.searchsorted(t[0], [p, p + 1]) for t in (edges, seeds))
        yield [v[i:j] for v in edges[1:]], [v[k:m] for v in seeds[1:]]


def _numbered(part: tuple, names: list[str], kinds: list) -> Part:
    at = {a: i for i, a in enumerate(names)}
    froms, tos = (np.array([at[k[i]] for k in kinds], dtype=np.int64) for i in (0, 1))
    return Part(*part, names, froms, tos)


def _text(names: list, codes: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes))


def union_walk(max_hops: int, once: bool = False) -> Callable:
    """Seeds are (block, bit): block, board, alarm, hop and the union of the masks that reach them; with ``once`` at their first hop only."""

    def walk(part, names, kinds):
        p = _numbered(part, names, kinds)
        order = np.argsort(p.to, kind="stable")
        from_, to = p.from_[order], p.to[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        for block in np.unique(p.seed_n):
            own = p.seed_n == block
            mask = np.zeros(p.size, np.int64)
            np.bitwise_or.at(mask, p.seed[own], np.int64(1) << p.seed_at[own])
            known = np.zeros(p.size, np.int64)
            for hop in range(max_hops + 1):
                if hop:
                    before, mask = mask, np.zeros(p.size, np.int64)
                    if len(to):
                        mask[to[first]] = np.bitwise_or.reduceat(before[from_], first)
                if once:
                    mask &= ~known
                    known |= mask
                at = np.flatnonzero(mask)
                if not len(at):
                    break
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(p.boards[p.board[at]]), _text(names, p.alarm[at]), pa.array(np.full(len(at), hop, np.int32)), pa.array(mask[at])], ["block", "board", "alarm", "hop", "mask"])

    return walk


def timed_walk(max_hops: int, waits: Callable) -> Callable:
    """Seeds are (block, bit): masks by earliest arrival, then smallest cause and rule. ``waits`` gives a kind's seconds."""

    def walk(part, names, kinds):
        p = _numbered(part, names, kinds)
        rule, wait = (np.array([f(k) for k in kinds], dtype=np.int32) for f in (lambda k: k[2], waits))
        # The first causes of all places, then the second: those of one place in order of board and rule.
        order = np.lexsort((rule[p.code], p.board[p.from_], p.to))
        to = p.to[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
        nth = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        order = order[np.argsort(nth, kind="stable")]
        from_, to, code = p.from_[order], p.to[order], p.code[order]
        rounds = np.r_[0, np.cumsum(np.bincount(nth))] if len(to) else np.zeros(1, np.int64)
        by_wait = {w: np.flatnonzero(wait[code] == w) for w in np.unique(wait[code]).tolist()}
        blocks = np.unique(p.seed_n)
        some = max(1, AT_ONCE // max(1, len(to)))
        for i in range(0, len(blocks), some):
            here = blocks[i : i + some]
            own = np.isin(p.seed_n, here)
            level = {0: np.zeros((p.size, len(here)), np.int64)}
            np.bitwise_or.at(level[0], (p.seed[own], np.searchsorted(here, p.seed_n[own])), np.int64(1) << p.seed_at[own])

            def rows(state, col, mask, hop, arrival, prev, by, here=here):
                n = len(state)
                return pa.RecordBatch.from_arrays(
                    [pa.array(here[col]), pa.array(p.boards[p.board[state]]), _text(names, p.alarm[state]), pa.array(np.full(n, hop, np.int32)), pa.array(np.full(n, arrival, np.int32)), pa.array(prev), pa.array(by), pa.array(mask)],
                    ["block", "board", "alarm", "hop", "arrival_s", "prev", "rule_idx", "mask"],
                )

            at, col = np.nonzero(level[0])
            yield rows(at, col, level[0][at, col], 0, 0, p.boards[p.board[at]], np.full(len(at), -1, np.int32))
            for hop in range(1, max_hops + 1):
                known, now = np.zeros((p.size, len(here)), np.int64), {}
                for arrival in sorted({a + w for a in level for w in by_wait}):
                    new = np.zeros((len(to), len(here)), np.int64)
                    for w, at in by_wait.items():
                        if arrival - w in level:
                            new[at] = level[arrival - w][from_[at]]
                    before = known.copy()
                    for j, k in zip(rounds[:-1], rounds[1:], strict=True):
                        there = to[j:k]
                        new[j:k] &= ~known[there]
                        known[there] |= new[j:k]
                    at, col = np.nonzero(new)
                    if len(at):
                        now[arrival] = known & ~before
                        yield rows(to[at], col, new[at, col], hop, arrival, p.boards[p.board[from_[at]]], rule[code[at]])
                level = now

    return walk


def in_time(starts: DataFrame, apart_s: int) -> DataFrame:
    """``apart``: seeds of a cell more than ``apart_s`` seconds after all before them begin anew, as no arrival of one meets those of the other."""
    w = W.partitionBy("cell").orderBy("at")
    new = F.when(F.col("at") - F.lag("at").over(w) <= apart_s, 0).otherwise(1)
    return starts.withColumn("_new", new).withColumn("apart", F.sum("_new").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("_new")


def _edges_of(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all edges of ``rows``, one row after the other, and which row each belongs to."""
    n = start[rows + 1] - start[rows]
    whose = np.repeat(np.arange(len(rows)), n)
    return np.arange(len(whose)) + np.repeat(start[rows] - (np.cumsum(n) - n), n), whose


def queue_walk(max_hops: int, waits: Callable, per_root: bool, cover: int, brief: bool) -> Callable:
    """Seeds are (id, start, duration): rows as a queue of all seeds of a part (with ``per_root`` of each) gives them, second after second.

    A row's place in the queue is one number, made of its cause's place, the rule and the board it leads to. At a second, the places of all boards
    with alarms are known before those they cause. Of the rows that wait alike, the first in the queue name nearly all targets; what they leave is
    looked up from the targets' side.
    """
    big = np.iinfo(np.int64).max

    def walk(part, names, kinds):
        p = _numbered(part, names, kinds)
        rules = np.unique([k[2] for k in kinds])
        rank = np.searchsorted(rules, [k[2] for k in kinds])
        many, n_boards = max(1, len(rules)), len(p.boards)
        wait = np.array([waits(k) for k in kinds], dtype=np.int64)
        ways = []
        for w in np.unique(wait[p.code]).tolist() if len(p.code) else []:
            at = np.flatnonzero(wait[p.code] == w)
            at = at[np.lexsort((rank[p.code[at]], p.from_[at]))]
            from_, to = p.from_[at], p.to[at]
            start = np.searchsorted(from_, np.arange(p.size + 1))
            back = np.argsort(to, kind="stable")
            # States with the same alarm have much the same targets.
            group = p.alarm[: p.size]
            targets = {g: np.unique(to[group[from_] == g]) for g in np.unique(group[from_]).tolist()}
            ways.append((w, from_, to, rank[p.code[at]], p.code[at], start, back, np.searchsorted(to[back], np.arange(p.size + 1)), group, targets))

        def caused(way, states, ks):
            """Smallest cause of each state and the edge that brings it."""
            _, from_, to, by, _, start, back, back_start, group, targets = way
            best, edge = np.full(p.size, big), np.full(p.size, -1)
            has = start[states + 1] > start[states]
            states, ks = states[has], ks[has]
            if not len(states):
                return best, edge
            order = np.argsort(ks)
            states, ks = states[order], ks[order]
            sums = np.cumsum(start[states + 1] - start[states])
            able = np.zeros(p.size, bool)
            for g in np.unique(group[states]).tolist():
                able[targets[g]] = True
            few = np.searchsorted(sums, cover * np.count_nonzero(able)) + 1
            few = len(states) if few < len(states) and sums[-1] <= 2 * sums[few - 1] else few
            at, whose = _edges_of(start, states[:few])
            cause, there = ks[:few][whose] * many + by[at], to[at]
            best[there[::-1]], edge[there[::-1]] = cause[::-1], at[::-1]
            if few < len(states):
                gaps = np.flatnonzero(able & (best == big))
                if len(gaps):
                    place = np.full(p.size, big)
                    place[states[few:]] = ks[few:]
                    at, whose = _edges_of(back_start, gaps)
                    at = back[at]
                    ok = place[from_[at]] < big
                    at, whose = at[ok], whose[ok]
                    cause = place[from_[at]] * many + by[at]
                    order = np.argsort(-cause, kind="stable")
                    best[gaps[whose[order]]], edge[gaps[whose[order]]] = cause[order], at[order]
            return best, edge

        def rows(t, hop, state, seed, from_, code, w):
            root = p.seed_board[seed]
            first = p.alarm[p.seed[seed]]
            back = pa.array(from_ < 0)
            prev = pa.compute.if_else(back, pa.scalar(None, pa.int64()), pa.array(p.boards[p.board[from_]]))
            event = np.where(from_ < 0, first, p.alarm[from_])
            by = np.array([k[2] for k in kinds] + [-1], dtype=np.int32)[code]
            named = [] if brief else [_text([k[3] for k in kinds] + [""], code % (len(kinds) + 1)), _text([k[4] for k in kinds] + [""], code % (len(kinds) + 1))]
            return pa.RecordBatch.from_arrays(
                [pa.array(p.boards[p.board[state]]), _text(names, p.alarm[state]), pa.array(t), pa.array(hop), pa.array(root), _text(names, first), _text(names, event),
                 pa.array(t - w), pa.array(p.seed_lasts[seed]), prev, pa.array(by), *named, pa.array(w.astype(np.int32))],
                ["board", "alarm", "arrival_s", "hop", "root", "root_event", "event", "start_s", "duration_s", "prev", "rule_idx", *([] if brief else ["edge_type", "direction"]), "delay_s"],
            )

        order = np.lexsort((p.seed_board, p.seed_n))
        groups = [order]
        if per_root:
            order = order[np.argsort(p.seed_board[order], kind="stable")]
            groups = np.split(order, np.flatnonzero(np.diff(p.seed_board[order])) + 1)
        longest = max([w for w, *_ in ways], default=0)
        for own in groups:
            levels: list[dict] = [{} for _ in range(max_hops + 1)]
            times, due = [], set()

            def later(t, times=times, due=due):
                if t not in due:
                    due.add(t)
                    heappush(times, t)

            for t in np.unique(p.seed_at[own]).tolist():
                k = np.flatnonzero(p.seed_at[own] == t)
                _, once = np.unique(p.seed[own[k]], return_index=True)  # of seeds alike, the first
                k = k[once]
                levels[0][t] = (p.seed[own[k]], k.astype(np.int64), own[k])
                later(t)
            out, n_out = [], 0
            while times:
                t = heappop(times)
                if t in levels[0]:
                    state, _, seed = levels[0][t]
                    none = np.full(len(state), -1)
                    out.append((t, 0, state, seed, none, none, np.zeros(len(state), np.int64)))
                for hop in range(1, max_hops + 1):
                    best, got = None, None
                    for way in ways:
                        source = levels[hop - 1].get(t - way[0])
                        if source is None:
                            continue
                        state, k, seed = source
                        cause, edge = caused(way, state, k)
                        seeds_at = np.zeros(p.size, np.int64)
                        seeds_at[state] = seed
                        hit = np.flatnonzero(edge >= 0)
                        if best is None:
                            best, got = np.full(p.size, big), [np.zeros(p.size, np.int64) for _ in range(4)]
                        hit = hit[cause[hit] < best[hit]]
                        best[hit] = cause[hit]
                        e = edge[hit]
                        for v, x in zip(got, (seeds_at[way[1][e]], way[1][e], way[4][e], way[0]), strict=True):
                            v[hit] = x
                    if best is None or not len(state := np.flatnonzero(best < big)):
                        continue
                    seed, from_, code, w = (v[state] for v in got)
                    out.append((t, hop, state, seed, from_, code, w))
                    n_out += len(state)
                    if hop < max_hops:
                        levels[hop][t] = (state, best[state] * n_boards + p.board[state], seed)
                if t in levels[0] or any(t in v for v in levels):
                    for w, *_ in ways:
                        if w:
                            later(t + w)
                for v in levels:
                    for old in [x for x in v if x <= t - longest]:
                        del v[old]
                if n_out > 200_000:
                    yield from (rows(*x) for x in _joined(out))
                    out, n_out = [], 0
            yield from (rows(*x) for x in _joined(out))

    return walk


def _joined(out: list[tuple]) -> Iterator[tuple]:
    """Rows of several seconds and hops as one batch's arrays."""
    if out:
        sizes = [len(x[2]) for x in out]
        yield np.repeat([x[0] for x in out], sizes), np.repeat(np.array([x[1] for x in out], np.int32), sizes), *(np.concatenate([x[i] for x in out]) for i in range(2, 7))
