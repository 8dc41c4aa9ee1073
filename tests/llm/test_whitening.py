"""Whitening against the eigenvectors of the dense covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def dense(vectors, scale=256.0):
    """Fit list, whole numbers, falling eigenvalues and eigenvectors of the covariance over distinct vectors."""
    x = np.floor(scale * np.array(vectors, "f8"))
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(fit))
    return x, fit, e[::-1], v[:, ::-1]


def held(out, ids, vectors, k=4):
    x, fit, e, v = dense(vectors)
    want = (x - fit.mean(axis=0)) @ v[:, :k] / np.sqrt(e[:k])
    got = {(r["vec_id"], r["component"]): r for r in out}
    assert len(got) == len(out) == len(ids) * k
    w = np.array([[got[i, j + 1]["whitened"] for j in range(k)] for i in ids])
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w - want * sign).max() < 1e-9
    sums = [int(s) for s in fit.sum(axis=0)]
    for i, row in zip(ids, x, strict=True):
        far = sum((len(fit) * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True))
        assert {got[i, j + 1]["deviation"] for j in range(k)} == {far} and got[i, 1]["n"] == len(fit)
    for j in range(k):
        assert abs(got[ids[0], j + 1]["explained"] - e[j] / e.sum()) < 1e-10
    assert all(r["identity_error"] < 1e-8 for r in out)


def test_op13_equals_dense(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    held(queries.op13_gkl_whitening(spark, "/root/testdata/sf0.01").collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_copies_count_once_and_falling_spectrum_ends_early(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((300, 40)) * 0.5 ** np.arange(40) * 50).round(3)
    vectors = np.vstack([base, np.repeat(base[:1], 150, axis=0)]).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    held(whitening.whiten(df).collect(), list(range(len(vectors))), vectors)


def test_repeated_deviations_and_low_rank():
    """Directions that a single run can not tell apart are all found; the product is dense here."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    for of in ([9.0, 9.0, 9.0, 9.0, 9.0] + [1.0] * 25, [7.0, 5.0, 5.0] + [0.0] * 27, [4.0] * 30, [8.0, 8.0, 3.0, 3.0, 3.0, 2.0] + [1e-3] * 24):
        m = (basis * np.array(of)) @ basis.T
        s, v = whitening.leading(lambda c, m=m: (m.T @ (m @ c), (m @ c) @ (m @ c)), 30, np.linalg.norm(m), whitening.Whitening())
        want = [x for x in of if x][:4]
        assert np.allclose(s, want, rtol=1e-12) and np.allclose(v @ v.T, np.eye(len(want)), atol=1e-12)
        assert np.abs(m @ v.T - v.T * s).max() < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)]])
def test_nothing_to_tell_apart(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_awkward_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0]), (None, [3.0, 0.0]), (9, [3e9, 0.0]), (10, [-0.001, 0.0])]
    clash = {c: F.lit("x") for c in ("x", "v", "n", "m", "k", "component", "whitened")}
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).withColumns(clash)).collect()
    # All lie on one line: one component for each of the five rows that take part.
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in out) == [(0, 1, 4), (7, 1, 4), (7, 1, 4), (9, 1, 4), (10, 1, 4)]
    far = {r["vec_id"]: r["deviation"] for r in out}
    x = {7: 0, None: 768, 9: 256 * 3_000_000_000, 10: -1}
    sums = sum(x.values())
    # Beyond 64 bits there is no number.
    assert far == {i: v if (v := (4 * c - sums) ** 2) < 2**63 else None for i, c in x.items()}
    assert len({r["whitened"] for r in out if r["vec_id"] == 7}) == 1
