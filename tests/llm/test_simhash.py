"""Golay keys, fingerprints and components against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumentrace.llm import golay_simhash, queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_print(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=4):
    """Smallest id reachable, for a list of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    fp = np.array([f for _, f in prints], "u8")
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= bits) + i + 1:
            parent[top(int(j))] = top(i)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(prints))]


def test_code():
    """Each word of 23 bits is within three bits of one codeword; words within two bits share an index."""
    every = np.arange(1 << 23)
    nearest, five = golay_simhash.codewords(every)
    code = np.flatnonzero(golay_simhash._syndromes(every) == 0)
    assert len(code) == 4096 and np.array_equal(code >> 11, np.arange(4096)) and np.bitwise_count(code[1:]).min() == 7
    assert np.bitwise_count(code[nearest] ^ every).max() == 3
    assert np.bitwise_count(code[five] ^ every[:, None]).max() == 4
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 23, 50_000)
    mine = np.column_stack([nearest[x], five[x]])
    for a in range(23):
        for b in range(a, 23):
            y = x ^ (1 << a) ^ (1 << b if b != a else 0)
            theirs = np.column_stack([nearest[y], five[y]])
            assert (mine[:, :, None] == theirs[:, None, :]).any(axis=(1, 2)).all()
            # One bit apart: the nearest of one is among those of the other.
            assert a != b or (mine[:, :1] == theirs).any(axis=1).all()


def test_fingerprint_of_spark_hashes(spark):
    text = "One two  Three\tfour fünf six\nseven one TWO three four"
    w = text.lower().split()
    h = [r[0] % 2**64 for r in spark.createDataFrame([(" ".join(w[i : i + 4]),) for i in range(len(w) - 3)], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert golay_simhash.fingerprint(text.encode(), 4) == want == plain_print(text)


def test_op11_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    prints = [(d, plain_print(t)) for d, t in docs]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, plain_components(prints), strict=True)}
    out = queries.op11_golay_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == want and len(out) == len(docs)
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("block", [8192, 20])
def test_clouds_of_fingerprints(spark, block):
    """Clouds around a few centres and chains of single steps, with keys crowded beyond a block."""
    rng = np.random.default_rng(9)
    fp = []
    for centre in rng.integers(0, 2**63, 6).astype("u8"):
        for _ in range(150):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fp.append(centre ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype("u8")) if len(flips) else centre)
    step = np.uint64(rng.integers(0, 2**63))
    for _ in range(60):
        flips = rng.choice(64, 4, replace=False).astype("u8")
        step ^= np.bitwise_or.reduce(np.uint64(1) << flips)
        fp.append(step)
    fp = np.unique(np.array(fp, "u8"))
    how = golay_simhash.Fuzzy(block=block)
    nodes = spark.createDataFrame([(int(x),) for x in fp.view("i8")], "fp long").repartition(3)
    rows = golay_simhash.key_rows(nodes)
    many = golay_simhash.crowded(rows, len(fp), how)
    assert (many.count() > 0) == (block == 20)
    parts = golay_simhash.components(golay_simhash.links(golay_simhash.deal(rows, many), how).distinct())
    got = {r["node"]: r["component"] for r in parts.collect()}
    want = plain_components([(int(x), f) for x, f in zip(fp.view("i8"), fp, strict=True)])
    assert [got.get(int(x), int(x)) for x in fp.view("i8")] == want


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, empty):
    long = "word after word goes on " * 40_000
    rows = [(5, None), (4, ""), (9, " \t"), (3, "one two"), (2, "ONE  two"), (2, "ONE  two"), (None, "one two"), (None, "words of a row without id"), (8, long), (7, long)]
    clash = {c: F.lit(1) for c in ("fp", "key", "least", "root", "node", "component", "component_id", "fingerprint", "grp", "pair")}
    df = spark.createDataFrame([] if empty else rows, "doc_id long, text string").withColumns(clash)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in golay_simhash.near_components(df).collect()), key=str)
    want = [(d, f"{plain_print(t):016x}", c) for d, t, c in ((5, None, 4), (4, "", 4), (9, "", 4), (3, "one two", 2), (2, "one two", 2), (2, "one two", 2), (None, "one two", 2), (None, "words of a row without id", None), (8, long, 7), (7, long, 7))]
    assert got == ([] if empty else sorted(want, key=str))
