"""SimHash near duplicates: fingerprint segments become indices of Golay codewords, rows that share keys are compared.

1. One pass reduces a text to a 64-bit fingerprint: a bit is set where more than half of the shingles' hashes have it. From
   here on equal fingerprints are one node.
2. A fingerprint is three segments of 22, 21 and 21 bits. The perfect Golay code of 23 bits has one codeword within
   three bits of any segment. A segment within two bits of its codeword gives that one's index as key, one at three bits also
   the five indices of the codewords at four: any two segments that differ in at most two bits share a key.
3. At most four differing bits lie on three segments so that two of them have at most two: one of the two has none, or both
   have one. So keys are (segment itself, index of another) for each ordered pair, and (index, index) for each pair, where
   one of the two is the nearest codeword's. No link is lost.
4. Rows are dealt by key. Inside a key, members are taken up one after the other with all that link to them among
   those not reached yet, so a cloud of near copies costs as many comparisons as it has members, and gives a link a
   member. A key of more than ``block`` members, found by counting first, is dealt as pairs of blocks.
5. Links are merged into components, and each takes its smallest id.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle are one; equal fingerprints, repeated rows among them, are one component; a null id is never a component's id if
the component has another; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .minhash_bayes import components

#: Seed of the shingles' hash, and the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
SEED = 42
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))


@dataclass(frozen=True)
class Fuzzy:
    shingle: int = 4
    #: Bits in which linked fingerprints may differ; the keys hold for four and fewer.
    bits: int = 4
    #: Members of a key that one task compares at once.
    block: int = 8192


def fingerprint(text: bytes | None, size: int) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - size + 1)
    cuts = zip(starts[:n].tolist(), (ends[len(words) - n :] - 1).tolist(), strict=True)
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cuts], "<u8")
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 4096):
        bits = np.unpackbits(h[lo : lo + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, how: Fuzzy, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed number of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), how.shingle) for t in batch.column(1)], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of polynomials over two elements, given as bits, modulo the generator."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the error of at most three bits, and five of four bits (the first one five times where it has under three)."""
    one = 1 << np.arange(23)
    near, far = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64)
    sets, light = np.zeros(1, np.int64), []
    for _ in range(4):
        # Larger sets of places: each set with a place above its highest.
        sets = np.concatenate([sets[(sets >> k) == 0] | b for k, b in enumerate(one)])
        light.append(sets)
    for some in light[:3]:
        near[_syndromes(some)] = some
    of = _syndromes(light[3])
    order = np.argsort(of, kind="stable")
    heavy = np.bitwise_count(near) == 3
    far[np.flatnonzero(heavy)] = light[3][order].reshape(-1, 5)
    far[~heavy] = near[~heavy, None]
    return near, far


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword, and of five more at distance four (the nearest again where it is within two)."""
    near, far = _errors()
    s = _syndromes(segment)
    return (segment ^ near[s]) >> 11, (segment[:, None] ^ far[s]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, fingerprint) rows of distinct fingerprints, without repeats."""
    raw = fp.view("u8")
    parts = [(raw >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    nearest, five = zip(*map(codewords, parts), strict=True)
    every = [np.column_stack([n, f]) for n, f in zip(nearest, five, strict=True)]
    made = []
    for i in range(3):
        for j in range(3):
            if i != j:
                # The segment itself and an index of another: codewords within reach of two bits.
                made.append((parts[i][:, None] << 12 | every[j]) << 4 | (i * 3 + j))
                # The nearest of one and any of another; both orders of a pair meet under one tag.
                a, b = (nearest[i][:, None], every[j]) if i < j else (every[j], nearest[i][:, None])
                made.append(((a << 12 | b) | 1 << 40) << 4 | (min(i, j) * 3 + max(i, j)))
    rows = np.hstack(made)
    rows.sort(axis=1)
    first = np.ones(rows.shape, bool)
    first[:, 1:] = rows[:, 1:] != rows[:, :-1]
    return rows[first], np.repeat(fp, first.sum(axis=1))


def key_rows(nodes: DataFrame) -> DataFrame:
    """``key`` and ``fp``; about sixty rows a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                for lo in range(0, len(batch), 2048):
                    made = keys(batch.column(0).slice(lo, 2048).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def crowded(rows: DataFrame, nodes: int, how: Fuzzy) -> DataFrame:
    """Keys of more than ``block`` members and their number of blocks, at most one in ``block`` rows.

    Hashes of keys are counted first, in so many groups that tasks can add up most of them before rows are exchanged; only in
    groups that are crowded as a whole are keys counted one by one.
    """
    group = F.pmod(F.xxhash64("key"), F.lit(max(1, 60 * nodes * 8 // how.block)))
    full = rows.groupBy(group.alias("grp")).count().filter(F.col("count") > how.block).select("grp")
    full = materialise(full, "groups")
    if not full.head(1):
        return full.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("int").alias("n_blocks")).limit(0)
    some = rows.withColumn("grp", group).join(full, "grp", "left_semi").groupBy("key").count().filter(F.col("count") > how.block)
    found = materialise(some.select("key", F.ceil(F.col("count") / how.block).cast("int").alias("n_blocks")), "crowded")
    discard(full)
    return found


def _linked(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among ``fp``."""
    out, rest, front = [], fp.copy(), []
    while len(rest):
        at = front.pop() if front else None
        if at is None:
            at, rest = rest[0], rest[1:]
        near = np.bitwise_count(rest ^ at) <= bits
        if near.any():
            reached = rest[near].tolist()
            out += [(at, x) for x in reached]
            front += [np.uint64(x) for x in reached]
            rest = rest[~near]
    return out


def links(dealt: DataFrame, how: Fuzzy) -> DataFrame:
    """``a`` and ``b`` of linked nodes among rows (key, pair, fp) that share key and pair, sorted by them."""

    def found(key: np.ndarray, pair: np.ndarray, fp: np.ndarray) -> np.ndarray:
        edge = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        out = []
        # Two and three members, nearly all keys that hold more than one: every pair at once.
        for step, least, most in ((1, 2, 2), (1, 3, 3), (2, 3, 3)):
            at = starts[(sizes >= least) & (sizes <= most)]
            at = (at[:, None] + np.arange(most - step)).ravel()
            a, b = fp[at], fp[at + step]
            good = np.bitwise_count(a ^ b) <= how.bits
            out.append(np.column_stack([a[good], b[good]]))
        for lo, n in zip(starts[sizes > 3].tolist(), sizes[sizes > 3].tolist(), strict=True):
            got = _linked(np.unique(fp[lo : lo + n]), how.bits)
            if got:
                out.append(np.array(got, "u8"))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, "i8")] * 3
        for batch in batches:
            now = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            # What shares the last key may go on in the next batch.
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = int(np.argmax(last))
            held = [c[cut:] for c in now]
            if cut:
                yield out(found(now[0][:cut], now[1][:cut], now[2][:cut].view("u8")))
        if len(held[0]):
            yield out(found(held[0], held[1], held[2].view("u8")))

    def out(pairs: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.sort(pairs.view("i8"), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def deal(rows: DataFrame, many: DataFrame) -> DataFrame:
    """Rows (key, pair, fp) dealt and sorted by key and pair of blocks; keys that are not crowded have one pair."""
    block = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    pairs = F.transform(other, lambda o: F.least(block, o) * F.col("n_blocks") + F.greatest(block, o))
    dealt = rows.join(many, "key", "left").select("key", F.explode(F.coalesce(pairs, F.array(F.lit(0)))).alias("pair"), "fp")
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair")


def near_components(docs: DataFrame, how: Fuzzy | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (hex digits) and ``component_id``."""
    how = how or Fuzzy()
    if how.bits > 4:
        raise ValueError("the keys meet for at most four differing bits")
    prints = materialise(fingerprints(docs, how, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    rows = key_rows(nodes)
    many = crowded(rows, nodes.count(), how)
    found = materialise(links(deal(rows, many), how).distinct(), "links")
    parts = materialise(components(found), "components")
    root = nodes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialise(root.join(least, "root").select("fp", "component_id"), "of")
    discard(nodes, found, parts)
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
