"""Periodic runs against plain loops, whole numbers of places, tiles of many sizes and awkward rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumentrace.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """(start, period, length) of all runs, period by period."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, unit = j - i + q, w[i : i + q]
            if length >= max(6, 4 * q) and not any(q % d == 0 and unit == unit[:d] * (q // d) for d in range(1, q)):
                out.append((i, q, length))
            i = max(j, i + 1)
    return sorted(out)


def plain_collapse(w, runs):
    gone = set()
    for start, q, length in runs:
        gone.update(range(start + q, start + length))
    return [x for i, x in enumerate(w) if i not in gone]


def made_text(rng):
    w = []
    for _ in range(rng.randint(0, 8)):
        unit = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
        times = rng.randint(1, 9)
        w += (unit * times)[: len(unit) * times - rng.randint(0, len(unit) - 1)]
    return " ".join(w)


@pytest.mark.parametrize("how", [periodic_runs.Runs(), periodic_runs.Runs(core=8, together=40), periodic_runs.Runs(core=16, near=60), periodic_runs.Runs(core=4, near=0, together=1)])
def test_runs_equal_plain_loops(spark, how):
    rng = random.Random(7)
    texts = [made_text(rng) for _ in range(250)] + ["x " * 300, "a b " * 200 + "c", " ".join(f"w{i % 61}" for i in range(700)), " ".join(f"w{i}" for i in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in periodic_runs.collapse(df, how).collect():
        w = r["text"].split()
        want = plain_runs(w)
        assert [(x["start"], x["period"], x["length"]) for x in r["runs"]] == want, r["doc_id"]
        assert r["collapsed"] == " ".join(plain_collapse(w, want))


def test_suspects_miss_nothing_where_sums_meet(spark):
    """Words in the order of a sequence for which sums modulo a power of two meet: comparisons of whole numbers decide."""
    w = ["a"]
    for _ in range(11):
        w += [{"a": "b", "b": "a"}[x] for x in w]
    got = periodic_runs.documents_with_runs(spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:100] * 5))], "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [2]
    assert [(x["start"], x["period"], x["length"]) for x in got[0]["runs"]] == plain_runs(w[:100] * 5)


def test_op12_equals_plain_loops(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op12_periodic_runs(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    with_runs = 0
    for r in out:
        w = WORD.findall(docs[r["doc_id"]] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        told = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
        assert r["n_runs"] == len(runs) and r["runs_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(plain_collapse(w, runs)).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[2], x[0], x[1]), default=None)
        want = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        with_runs += bool(runs)
    assert with_runs > 5


def test_awkward_rows(spark):
    clash = {c: F.lit(9) for c in ("runs", "n", "period", "low", "high", "row", "id", "key", "body", "text_key", "start")}
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b c " * 5), (None, "b c " * 5), (7, "x y z " * 60_000), (8, "ä b " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    out = periodic_runs.collapse(df)
    assert out.columns == [c for c in df.columns if c != "runs"] + ["runs", "collapsed"]
    got = sorted(((r["doc_id"] or 0, r["text"] or "", [tuple(x) for x in r["runs"]], r["collapsed"], r["key"]) for r in out.collect()), key=str)
    want = [
        (0, "b c " * 5, [(0, 2, 10)], "b c", 9),
        (0, "b c " * 5, [(0, 2, 10)], "b c", 9),
        (1, "", [], "", 9),
        (2, "", [], "", 9),
        (3, " \n\t ", [], "", 9),
        (4, "a a a a a", [], "a a a a a", 9),
        (4, "a a a a a a", [(0, 1, 6)], "a", 9),
        (4, "a a a a a a", [(0, 1, 6)], "a", 9),
        (7, "x y z " * 60_000, [(0, 3, 180_000)], "x y z", 9),
        (8, "ä b " * 6, [(0, 1, 6)], "ä b", 9),
    ]
    assert got == sorted(want, key=str)
    assert periodic_runs.collapse(df.limit(0)).count() == 0
