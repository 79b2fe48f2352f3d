"""Minimax sharding against a dynamic programme and against its own law."""

import random
import zlib
from collections import defaultdict

import pytest

from shelfwatch.llm import sharding
from shelfwatch.llm.queries import QUERIES

SCHEMA = "shard string, size int, text string, doc_id long, key int"


def frame(spark, rows):
    return spark.createDataFrame([("x", 1, t, i, 2) for i, t in rows], SCHEMA)


def best(sizes, n):
    """The smallest possible largest part of a contiguous partition into at most n."""
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, parts, now = (lo + hi) // 2, 1, 0
        for s in sizes:
            if now + s > mid:
                parts, now = parts + 1, 0
            now += s
        lo, hi = (lo, mid) if parts <= n else (mid + 1, hi)
    return lo


def check(spark, rows, n):
    got = sharding.shard_documents(frame(spark, rows), n).collect()
    assert len(got) == len(rows)
    texts, shards, slots, total = defaultdict(set), defaultdict(int), defaultdict(list), defaultdict(int)
    by_id = {i: t or "" for i, t in rows if i is not None}
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        if r.doc_id is not None:
            t = by_id[r.doc_id]
            assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
            texts[t].add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = frame(spark, rows).selectExpr("xxhash64(coalesce(text, '')) k", "octet_length(coalesce(text, '')) + 8 s").groupBy("k").sum("s").orderBy("k").collect()
    if keys:
        assert max(shards.values()) == best([k[1] for k in keys], n)


@pytest.mark.parametrize("bits, seed, n", [(16, 0, 5), (2, 1, 24), (1, 2, 3), (4, 3, 7)])
def test_law(spark, monkeypatch, bits, seed, n):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, "", "hot", "ü" * rnd.randrange(60), "z" * rnd.randrange(900)])) for i in range(300)]
    check(spark, [*rows, (None, "no id"), (None, "no id")] if seed else rows, n)


def test_few_and_none(spark):
    check(spark, [(1, "a"), (2, "a"), (3, None)], 24)
    check(spark, [(i, "same") for i in range(50)], 24)
    assert sharding.shard_documents(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op4_minimax_shards"](spark, sf).collect()}
    assert len(got) == len(docs) and {r.text_crc32 for r in got.values()} == {zlib.crc32(d.text.encode()) for d in docs}
