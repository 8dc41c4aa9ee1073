"""Embedding whitening: Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

1. Vectors become whole numbers (``floor(scale * c)``); every distinct one counts once. The distinct ones are packed in
   blocks and written down, since every step reads them.
2. A step sends one direction of the small space to the tasks, which return ``Xᵀ(Xc)`` and ``|Xc|²`` over the centred
   rows. A left vector ``u`` is never stored: it is ``Xc`` for a ``c`` that the driver keeps, so its products with
   all earlier left vectors follow from ``Xᵀ(Xc)``, and both sides are orthogonalised in full without another pass.
3. The singular vectors of the small bidiagonal matrix give components and deviations. Steps end when the residuals of
   the wanted ones are at rounding level, or the space is used up. A further run in what is orthogonal to the
   components found makes sure that none was missed, as a repeated deviation shows one direction a run only.

The driver holds a few numbers a step and dimension, whatever the number of rows.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another
length than the most common one (the larger of equally common ones counts); whole numbers beyond 64 bits end there;
components without deviation are left out, so equal vectors, a single one or an empty table give no rows; repeated rows
and ids, null ones among them, are rows of their own; a ``deviation`` beyond 64 bits is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    components: int = 4
    scale: float = 256.0
    #: Vectors in one block.
    block: int = 2048
    #: Residual, as a share of the largest deviation, at which a component counts as found.
    residual: float = 1e-14
    #: What is below this share of the whole deviation counts as none.
    nothing: float = 1e-12


def whole(rows: DataFrame, how: Whitening, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``x`` (whole numbers) of the rows that take part."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    df = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    df = df.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(F.exists("v", bad), F.lit(True)))
    sizes = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    df = df.filter(F.size("v") == (sizes["n"] if sizes else 0))
    return df.select("vec_id", F.transform("v", lambda c: F.floor(c * how.scale)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_blocks(x: DataFrame, how: Whitening) -> DataFrame:
    """The distinct vectors in blocks: ``m`` holds rows of 64-bit numbers, ``n`` their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), how.block):
                m = _matrix(batch.column(0).slice(lo, how.block)).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()), pa.array([len(m)], pa.int64())], ["m", "n"])

    return x.select("x").distinct().mapInArrow(run, "m binary, n long")


def totals(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of ``of(matrix)``, a vector of doubles; added up in tasks first, then by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw, n in zip(batch.column(0), batch.column(1), strict=True):
                part = of(np.frombuffer(raw.as_py(), "<i8").reshape(n.as_py(), -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype="i4")), pa.array(total)], ["k", "part"])

    found = blocks.mapInArrow(run, "k int, part double").groupBy("k").agg(F.sum("part").alias("total")).collect()
    return np.array([r["total"] for r in sorted(found)])


def exact_sums(blocks: DataFrame) -> list[int]:
    """Sums of each dimension, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, n in zip(batch.column(0), batch.column(1), strict=True):
                m = np.frombuffer(raw.as_py(), "<i8").reshape(n.as_py(), -1)
                halves = [pa.array((m >> 32).sum(axis=0)), pa.array((m & 0xFFFFFFFF).sum(axis=0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[1], dtype="i4")), *halves], ["k", "high", "low"])

    parts = blocks.mapInArrow(run, "k int, high long, low long").groupBy("k")
    added = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    return [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(parts.agg(*added).collect())]


def _apart(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` without its parts along ``basis``, taken off twice."""
    for _ in range(2):
        v = v - (basis @ v) @ basis
    return v


def bidiagonalise(product: Callable, size: int, whole_deviation: float, want: int, against: np.ndarray, how: Whitening) -> tuple[np.ndarray, np.ndarray, bool]:
    """Deviations (falling) and directions in what is orthogonal to ``against``, and whether that space is used up.

    ``product(c)`` gives ``Xᵀ(Xc)`` and ``|Xc|²``.
    """
    rng = np.random.default_rng(len(against) + 1)
    tiny = how.nothing * whole_deviation
    steps = size - len(against)
    right, left, image = against, np.empty((0, size)), np.empty((0, size))
    diagonal, beside = [], []
    v, c = None, np.zeros(size)
    while True:
        if v is None:
            v = _apart(rng.standard_normal(size), right)
            v /= np.linalg.norm(v)
        right = np.vstack([right, v])
        c = v - (beside[-1] * c if beside else 0.0)
        z, squared = product(c)
        along = left @ z
        c, z, rest = c - along @ left, z - along @ image, squared - along @ along
        if tiny**2 < rest < 0.5 * squared:  # much was taken off: count again
            z, rest = product(c)
        deviation = np.sqrt(max(rest, 0.0))
        if deviation <= tiny:
            deviation, c, z = 0.0, np.zeros(size), np.zeros(size)
        else:
            c, z = c / deviation, z / deviation
        left, image = np.vstack([left, c]), np.vstack([image, z])
        diagonal.append(deviation)
        onward = _apart(z, right)
        length = np.linalg.norm(onward)
        onward, length = (onward / length, length) if length > tiny else (None, 0.0)
        small = np.diag(diagonal) + np.diag(beside, 1)
        p, s, q = np.linalg.svd(small)
        used = len(diagonal) == steps
        if used or (len(s) >= want and (length * np.abs(p[-1, :want]) <= how.residual * s[0]).all() and length > 0):
            return s, q @ right[len(against) :], used
        beside.append(length)
        v = onward


def leading(product: Callable, size: int, whole_deviation: float, how: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """The largest deviations of the centred rows and their unit directions."""
    found, of = np.empty((0, size)), np.empty(0)
    while whole_deviation > 0 and len(found) < size:
        want = how.components if not len(found) else 1
        s, directions, used = bidiagonalise(product, size, whole_deviation, want, found, how)
        take = how.components if used else want
        more = len(of) < how.components or s[0] > of[how.components - 1]
        found, of = np.vstack([found, directions[:take]]), np.concatenate([of, s[:take]])
        order = np.argsort(-of, kind="stable")
        found, of = found[order], of[order]
        if used or not more:
            break
    good = of[: how.components] > how.nothing * whole_deviation
    return of[: how.components][good], found[: how.components][good]


def whiten(rows: DataFrame, how: Whitening | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row that takes part and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    how = how or Whitening()
    spark = rows.sparkSession
    x = whole(rows, how, id_col, vector_col)
    blocks = materialise(fit_blocks(x, how), "fit")
    n = blocks.agg(F.sum("n")).first()[0] or 0
    sums = exact_sums(blocks)
    middle = np.array([s / n for s in sums])
    spread = totals(blocks, lambda m: np.array([np.square(m - middle).sum()]))[0] if n else 0.0

    def product(c: np.ndarray) -> tuple[np.ndarray, float]:
        def part(m: np.ndarray) -> np.ndarray:
            centred = m - middle
            along = centred @ c
            return np.append(along @ centred, along @ along)

        found = totals(blocks, part)
        return found[:-1], found[-1]

    deviations, directions = leading(product, len(sums), np.sqrt(spread), how)
    k = len(deviations)
    if not k:
        discard(blocks)
        return spark.createDataFrame([], ROWS)
    project = (directions / (deviations / np.sqrt(n))[:, None]).T
    off = totals(blocks, lambda m: ((m - middle) @ project).sum(axis=0)) / n

    def squares(m: np.ndarray) -> np.ndarray:
        w = (m - middle) @ project - off
        return (w.T @ w).ravel()

    error = float(np.abs(totals(blocks, squares).reshape(k, k) / n - np.eye(k)).max())
    discard(blocks)
    explained = deviations**2 / spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            m = _matrix(batch.column(1))
            far = _deviation(m, n, sums)
            w = (m - middle) @ project
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(m)), k)))
            columns = [
                ids,
                pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(m))),
                pa.array(np.full(len(ids), n)),
                far.take(pa.array(np.repeat(np.arange(len(m)), k))),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, len(m))),
                pa.array(np.full(len(ids), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, ROWS)


def _deviation(m: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums over dimensions of ``(n * x - sum)²``, exact; null beyond 64 bits."""
    widest = n * max(abs(int(m.max())), abs(int(m.min()))) + max(map(abs, sums))
    if widest**2 * m.shape[1] < 2**63:
        return pa.array(np.square(n * m - np.array(sums)).sum(axis=1))
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in m.tolist()]
    return pa.array([v if v < 2**63 else None for v in out], pa.int64())
