"""Periodic runs: stretches of words that repeat with a smallest period at least four times over.

1. A document is cut once for every octave of periods, ``m / 2 <= q < m`` with ``m`` a power of two, into tiles of a core and
   a margin of ``m`` words on both sides, so larger periods get wider tiles. A document of up to ``near`` characters is
   solved where it is read; tiles of longer ones are dealt over tasks first, so none waits for one text.
2. In a tile every ``m``-th word is a boundary: a run of four periods holds at least one, with a period to its right.
   Boundaries that may lie in a run are found by comparing rolling sums of windows, which misses none. There
   Z-functions to the right and to the left give, for each period, how far words ``q`` apart stay identical, and tell
   periods that are multiples of a smaller one. All comparisons of a tile are of whole numbers that stand for its words.
3. What a tile finds is an interval of places that equal the place ``q`` further on. Intervals that are long
   enough, or reach the tile's end, are shuffled by document and period and stitched; what is long enough then is a run.
4. Texts in which something was found are written beside the intervals, so only these are exchanged to be collapsed.

Tiles of an octave are solved together, and work grows with words times octaves, whatever they repeat.

Defined results: null, empty and blank texts have no words and no runs; rows with equal id and text are one document
in step 3 and each get its result; a null id stands as 0 beside the ``text_key``, which tells it from a real 0; an
empty table gives an empty table; other columns of the table pass through ``collapse`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, words

PIECES = "doc_id long, text_key long, n long, period long, low long, high long, text binary"
TILES = "doc_id long, text_key long, n long, octave int, core long, ids binary"


@dataclass(frozen=True)
class Runs:
    #: Times that a period must stand, and words that a run has at least.
    times: int = 4
    least: int = 6
    #: Words in a tile's core; wide octaves have ``2 * m``.
    core: int = 1 << 14
    #: Characters up to which a text is solved where it is read.
    near: int = 1 << 18
    #: Words solved together.
    together: int = 1 << 18

    def need(self, q: int) -> int:
        """Places that must equal the one ``q`` further on."""
        return max(self.least, self.times * q) - q


def _tiles(doc: tuple, ids: np.ndarray, how: Runs) -> Iterator[tuple]:
    """(doc, n, octave's end, start of the core, ids) of a document, octave by octave."""
    n, m = len(ids), 2
    while n >= max(how.least, how.times * m // 2):
        core = max(how.core, 2 * m)
        for at in range(0, n, core):
            yield doc, n, m, at, ids[max(0, at - m) : at + core + m]
        m *= 2


def _ids(text: bytes | None) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in text.split()] if text else [], "<i4")


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


def _agree(a: list[int]) -> list[int]:
    """Z-function: for each place, how many numbers from there on equal those from the start."""
    n = len(a)
    z, low, high = [0] * n, 0, 0
    z[0] = n
    for i in range(1, n):
        k = min(high - i, z[i - low]) if i < high else 0
        if i + k >= high:
            while i + k < n and a[k] == a[i + k]:
                k += 1
            low, high = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def _shorter(q: int) -> tuple[int, ...]:
    """``q`` over each of its primes."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def _suspects(text: np.ndarray, bounds: np.ndarray, m: int, window: int) -> np.ndarray:
    """Boundaries where the next or the last ``window`` numbers may stand again ``q`` further on for a ``q`` of the octave.

    Rolling sums of 64 bits; equal windows have equal sums.
    """
    base = np.uint64(0x5851F42D4C957F2D)
    padded = np.concatenate([text, -1 - np.arange(3 * m + window, dtype=np.int64)])
    powers = np.ones(len(padded) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(padded), base), out=powers[1:])
    sums = np.zeros(len(padded) + 1, np.uint64)
    np.cumsum(_mixed(padded) * powers[:-1], out=sums[1:])
    # Windows are compared at a common power: the later one's sum against the earlier one's, raised by q.
    of = sums[window:] - sums[:-window]
    period = np.arange(m // 2, m)
    found = np.zeros(len(bounds), bool)
    step = max(1, (1 << 20) // len(period))
    for lo in range(0, len(bounds), step):
        b = bounds[lo : lo + step, None]
        right = (of[b] * powers[period] == of[b + period]).any(axis=1)
        back = np.maximum(b - window, 0)
        left = (of[back] * powers[period] == of[back + period]).any(axis=1) & (b[:, 0] >= window)
        found[lo : lo + step] = right | left
    return bounds[found]


def _intervals(tile: np.ndarray, bounds: list[int], m: int, how: Runs) -> dict[int, list[list[int]]]:
    """Per period that is no multiple of a shorter one: intervals of places equal to the one a period on, joined where they touch."""
    found: dict[int, list[list[int]]] = {}
    numbers = tile.tolist()
    for b in bounds:
        ahead = numbers[b : b + 2 * m]
        if len(ahead) <= m // 2:
            continue
        right = _agree(ahead)
        # Read backwards from the octave's end: where the last numbers before the boundary stand a period further on.
        first = max(0, b - m)
        behind = numbers[first:b][::-1]
        left = _agree([*behind, -1, *numbers[first : b + m][::-1]])
        most, end = len(behind), len(left) - (b - first)
        for q in range(m // 2, min(m, len(ahead))):
            on = min(right[q], m)
            # Place b - 1 + q is read this far from the end of the reversed stretch.
            before = left[end - q] if end - q > most else 0
            # A run reaches over a whole octave to one side, or lies between two.
            if on + before < m and on + before < how.need(q) or any(right[d] >= q - d for d in _shorter(q)):
                continue
            low, high = b - before, b + on
            spans = found.setdefault(q, [])
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
                spans[-1][0] = min(spans[-1][0], low)
            else:
                spans.append([low, high])
    return found


def _solve(tiles: list[tuple], how: Runs) -> Iterator[tuple]:
    """Fragments (doc, n, period, low, high) of tiles of one octave."""
    m = tiles[0][2]
    window = min(m, -(-how.need(m // 2) // 2))
    starts = np.cumsum([0] + [len(t[4]) for t in tiles])
    text = np.concatenate([t[4].astype(np.int64) + (i << 32) for i, t in enumerate(tiles)])
    # A tile's first boundary is its core's start.
    firsts = [s + t[3] - max(0, t[3] - m) for s, t in zip(starts, tiles, strict=False)]
    core = max(how.core, 2 * m)
    bounds = np.concatenate([np.arange(f, min(f + core, e), m) for f, e in zip(firsts, starts[1:], strict=True)])
    bounds = _suspects(text, bounds, m, window)
    of = np.searchsorted(starts, bounds, side="right") - 1
    for i in np.unique(of).tolist():
        doc, n, _, at, ids = tiles[i]
        shift = max(0, at - m)
        for q, spans in _intervals(ids, (bounds[of == i] - starts[i]).tolist(), m, how).items():
            for low, high in spans:
                low, high = low + shift, high + shift
                if high - low >= how.need(q) or (low <= shift and shift > 0) or (high >= at + core and high < n - q):
                    yield doc, n, q, low, high


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    names = ["doc_id", "text_key", "n", "period", "low", "high", "text"]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.binary())], names)


def _solved(tiles: Iterator[tuple], how: Runs, texts: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Fragments of all tiles, with a bounded number of words at a time, and what ``texts`` holds of documents with any (period 0)."""
    waiting: dict[int, list[tuple]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(*doc, n, q, low, high, None) for same in waiting.values() for doc, n, q, low, high in _solve(same, how)]
        if texts is not None:
            rows += [(*doc, 0, 0, 0, 0, texts[doc]) for doc in {r[:2] for r in rows}]
            texts.clear()
        return _batch(rows)

    for t in tiles:
        # A document's tiles follow one another; a new document may start a new round.
        if size >= how.together and (texts is None or t[3] == 0 and t[2] == 2):
            yield out()
            waiting, size = {}, 0
        if texts is not None and t[5] is not None:
            texts[t[0]] = t[5]
        waiting.setdefault(t[2], []).append(t[:5])
        size += len(t[4])
    if waiting:
        yield out()


def key_of(id_col: str, text_col: str) -> list[Column]:
    """``doc_id`` (0 for null) and ``text_key`` (a hash of the text and of the id's absence)."""
    text, number = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return [F.coalesce(number, F.lit(0)).alias("doc_id"), F.xxhash64(number.isNull(), text).alias("text_key")]


def pieces(docs: DataFrame, how: Runs) -> DataFrame:
    """One pass over ``docs`` (doc_id, text_key, text): fragments of texts that are solved here (period above 0), the texts of these
    documents (period 0), and texts that are to be dealt (period -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: list[tuple] = []

        def near() -> Iterator[tuple]:
            for batch in batches:
                for doc, key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    raw, doc = text.as_py(), (doc.as_py(), key.as_py())
                    if len(raw) > how.near:
                        far.append((*doc, 0, -1, 0, 0, raw))
                    else:
                        for t in _tiles(doc, _ids(raw), how):
                            yield *t, raw

        for batch in _solved(near(), how, {}):
            yield batch
            if far:
                yield _batch(far)
                far.clear()
        if far:
            yield _batch(far)

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, PIECES)


def dealt_fragments(far: DataFrame, how: Runs) -> DataFrame:
    """Fragments of long texts (doc_id, text_key, text), whose tiles are dealt over tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                for _, n, m, at, ids in _tiles((doc, key), _ids(text.as_py()), how):
                    columns = [doc.as_py()], [key.as_py()], [n], [m], [at], [ids.tobytes()]
                    kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_key", "n", "octave", "core", "ids"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, key, n, m, at, ids in zip(*batch.columns, strict=True):
                    yield (doc.as_py(), key.as_py()), n.as_py(), m.as_py(), at.as_py(), np.frombuffer(ids.as_py(), "<i4"), None

        yield from _solved(rows(), how)

    tiles = far.select("doc_id", "text_key", "text").mapInArrow(cut, TILES).repartition("doc_id", "text_key", "octave", "core")
    return tiles.mapInArrow(solve, PIECES)


def stitched(found: DataFrame, how: Runs) -> DataFrame:
    """Runs (``doc_id``, ``text_key``, ``start``, ``length``, ``period``) from the intervals of each document and period."""
    key = ["doc_id", "text_key", "period"]
    order = W.partitionBy(*key).orderBy("low", "high")
    rows = found.select(*key, "low", "high").distinct().withColumn("reach", F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("low") <= F.col("reach"), 0).otherwise(1)).over(order))
    whole = rows.groupBy(*key, "part").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    length = F.col("high") - F.col("start") + F.col("period")
    enough = length >= F.greatest(F.lit(how.least), F.col("period") * how.times)
    return whole.filter(enough).select("doc_id", "text_key", "start", length.alias("length"), "period")


def collapsed(text: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """The words of each text, joined by single spaces, without those from a ``low`` up to its ``high``."""

    def one(value: bytes, lows: np.ndarray, highs: np.ndarray) -> str:
        found = value.split()
        edge = np.zeros(len(found) + 1, np.int64)
        np.add.at(edge, lows, 1)
        np.add.at(edge, highs, -1)
        return b" ".join([w for w, gone in zip(found, np.cumsum(edge).tolist(), strict=False) if not gone]).decode("utf-8", "replace")

    return pd.Series([one(*row) for row in zip(text, low, high, strict=True)], dtype=object)


def documents_with_runs(docs: DataFrame, how: Runs | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with a run: ``doc_id``, ``text_key``, ``runs`` (by start, then period) and ``collapsed``, its words
    without what repeats, joined by single spaces."""
    how = how or Runs()
    rows = docs.select(*key_of(id_col, text_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = materialise(pieces(rows, how), "periods")
    fragments = found.filter("period > 0").drop("text").unionByName(dealt_fragments(found.filter("period = -1"), how).drop("text"))
    per = stitched(fragments, how).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = found.filter("period <= 0").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    drop = F.transform("runs", lambda r: r["start"] + r["period"]), F.transform("runs", lambda r: r["start"] + r["length"])
    return per.join(texts, ["doc_id", "text_key"]).select("doc_id", "text_key", "runs", F.pandas_udf(collapsed, "string")("text", *drop).alias("collapsed"))


def collapse(docs: DataFrame, how: Runs | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with two columns more: ``runs`` (empty where there are none) and ``collapsed``. Columns of these names are replaced."""
    found = documents_with_runs(docs, how, id_col, text_col)
    rest = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), *key_of(id_col, text_col), F.col(text_col).cast("string").alias("body"))
    joined = rows.join(found, ["doc_id", "text_key"], "left")
    none = F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")
    text = F.coalesce("collapsed", F.array_join(words(F.col("body")), " "))
    return joined.select("row", F.coalesce("runs", none).alias("runs"), text.alias("collapsed")).select("row.*", "runs", "collapsed")
