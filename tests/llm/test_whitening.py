"""Whitening against a plain covariance and exact sums."""

import math

import numpy as np
import pytest

from shelfwatch.llm import whitening
from shelfwatch.llm.queries import QUERIES

SCHEMA = "v string, vec_id long, embedding array<float>, n int, component string"


def frame(spark, rows):
    return spark.createDataFrame([("v", i, x, 3, "c") for i, x in rows], SCHEMA)


def check(got, rows, width, most=32):
    """got against all rows, of which those of this width with finite entries count."""
    used = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in x]) for i, x in rows if x is not None and len(x) == width and all(c is not None and math.isfinite(c) for c in x)]
    n, x = len(used), np.array([x for _, x in used], object)
    total = x.sum(axis=0)
    z = (x * n - total).astype(float) / n
    v = z.T @ z / n
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(most, int((e > e[0] * width * 8 * 2.3e-16).sum()))
    assert len(got) == n * k
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.deviation), [[] for _ in range(k)])[r.component - 1].append(r)
    want = {}
    for (i, xs), zs in zip(used, z, strict=True):
        want.setdefault((i, int(((n * np.array(xs, object) - total) ** 2).sum())), []).append(zs)
    assert set(by_id) == set(want)
    u = np.zeros((k, width))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    whole = np.array([[r.whitened for r in parts[0]] and [np.mean([r.whitened for r in p]) for p in parts] for parts in by_id.values()])
    zs = np.array([np.mean(want[key], axis=0) for key in by_id])
    times = np.array([len(want[key]) for key in by_id])
    assert all(len(p) == t for parts, t in zip(by_id.values(), times, strict=True) for p in parts)
    # Whitened values are z on the component over the root of its eigenvalue: least squares gives the component back.
    u = (np.linalg.pinv(zs) @ (whole * np.sqrt(e[:k]))).T if len(zs) >= width else None
    cov = (whole * times[:, None]).T @ whole / n
    assert np.abs(cov - np.eye(k)).max() < 1e-6
    if u is not None:
        assert np.abs(v @ u.T - u.T * e[:k]).max() < 1e-6 * e[0] and np.abs((u**2).sum(axis=1) - 1).max() < 1e-6
    for c in range(k):
        assert all(abs(r.explained / (e[c] / np.trace(v)) - 1) < 1e-6 and r.n == n for p in by_id.values() for r in p[c])


def vectors(n, width, seed):
    rnd = np.random.default_rng(seed)
    return (rnd.normal(size=(n, width)) @ rnd.normal(size=(width, width)) * 0.1 + 0.05).astype(np.float32).tolist()


@pytest.mark.parametrize("n, width, most", [(300, 5, 32), (900, 70, 32), (500, 33, 4)])
def test_plain(spark, monkeypatch, n, width, most):
    rows = list(enumerate(vectors(n, width, width)))
    check(whitening.whiten(frame(spark, rows).repartition(5), most).collect(), rows, width, most)


def test_odd_rows(spark):
    rows = list(enumerate(vectors(200, 6, 1)))
    rows += [(1, None), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (7, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (8, [float("nan")] * 6), (9, [float("inf")] + [0.0] * 5), (10, []), (11, [1.0]), (12, [9.0] * 900)]
    rows += [rows[0]] * 100
    check(whitening.whiten(frame(spark, rows).repartition(3)).collect(), rows, 6)


def test_no_variance(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 4)).collect() == []
    rows = [(k, [float(k), 2.0 * k]) for k in range(5)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_deviation_is_exact():
    big = np.array([[1 << 40, 0], [5, 7]])
    total = big.sum(axis=0)
    assert whitening.squared_deviation(big, 2, total) == [None, None]
    assert whitening.squared_deviation(big[1:], 3, np.array([2_999_999_990, 4])) == [(15 - 2_999_999_990) ** 2 + 17**2]


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitened_embeddings"](spark, sf).collect(), rows, 64)
