"""Nearest codes against brute force."""

import numpy as np
import pytest

from shelfwatch.llm import hamming
from shelfwatch.llm.queries import QUERIES


def brute(rows, every, k, bits):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None:
            x = np.zeros(bits, bool)
            got = np.array([e or 0 for e in v], dtype=float)
            x[: len(got)] = got > 0
            seen[i, x.tobytes()] = x
    keys = sorted(seen)
    table = np.stack([seen[x] for x in keys]) if keys else np.zeros((0, bits), bool)
    out = set()
    for a, (i, c) in enumerate(keys):
        if i % every == 0:
            d = (table != table[a]).sum(axis=1)
            best = sorted((int(d[b]), j, np.packbits(table[b]).tobytes()) for b, (j, _) in enumerate(keys) if b != a)[:k]
            out |= {(i, r, j, x) for r, (x, j, _) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("dim, shard, block", [(64, 200_000, 100_000), (40, 50, 7), (128, 300, 1000)])
def test_against_brute_force(spark, monkeypatch, dim, shard, block):
    monkeypatch.setattr(hamming, "SHARD", shard)
    monkeypatch.setattr(hamming, "BLOCK", block)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(5, dim))
    rows = [(i, [float(x) for x in centres[rng.integers(5)] + rng.normal(size=dim) * rng.choice([0.0, 0.3, 1.5])]) for i in range(400)]
    rows += [(1000, None), (None, rows[0][1]), (1020, []), (1040, [float("nan"), None, 1.0]), rows[3], (20, rows[3][1])]
    df = spark.createDataFrame([("x", *r) for r in rows], "code string, vec_id long, embedding array<double>")
    got = {tuple(r) for r in hamming.nearest_codes(df, 20, 10).collect()}
    assert got == brute(rows, 20, 10, -(-dim // 16) * 16)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in hamming.nearest_codes(df).collect()] == [(0, 1, 1, 1)]
    assert hamming.nearest_codes(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {tuple(r) for r in QUERIES["op6_nearest_codes"](spark, sf).collect()} == brute(rows, 20, 10, 64)
