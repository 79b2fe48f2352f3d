"""Near-duplicate components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import neardup
from shelfwatch.llm.queries import QUERIES


def brute(rows, k, percent):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i in sorted(sets):
        s = sets[i]
        near = set()
        for x in s:
            near.update(holders.setdefault(x, []))
            holders[x].append(i)
        for j in near:
            same = len(s & sets[j])
            if 100 * same >= percent * (len(s) + len(sets[j]) - same):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def same(got, want):
    got = {r.doc_id: r for r in got}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def near_copies(rnd, groups, copies, words, most):
    rows, i = [], 0
    for _ in range(groups):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(300)) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randrange(most + 1)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            rows.append((i, " ".join(x.upper() if rnd.random() < 0.5 else x for x in w)))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("node, k", [(64, 4), (4, 5)])
def test_against_brute_force(spark, monkeypatch, node, k):
    monkeypatch.setattr(neardup, "NODE", node)
    rnd = random.Random(node)
    rows = near_copies(rnd, 12, 12, 120, 6) + [(10_000 + i, t) for i, t in enumerate(["", None, " \t\n", "one", "ONE ", "one two", "é É", "é É ", "x " * 20_000, "x " * 9_000, "a\x0bb\x0cc d", "a b c d", "a\x1cb c d"])]
    df = spark.createDataFrame([(0, *r) for r in rows], "cid int, doc_id long, text string").repartition(5)
    same(neardup.cluster(df, k, 80).collect(), brute(rows, k, 80))


def test_large_group(spark):
    rows = near_copies(random.Random(9), 1, 500, 100, 5)
    same(neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect(), brute(rows, 4, 80))


@pytest.mark.parametrize("node, last", [(4096, 11), (128, 11), (128, 5)])
def test_group_spread_around_the_threshold(spark, monkeypatch, node, last):
    """Copies that are not all similar to any one of them, as a leaf, branched on, and cut into blocks."""
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "LAST_DEPTH", last)
    rows = near_copies(random.Random(3), 1, 1_200, 60, 6)
    want = brute(rows, 4, 80)
    assert 5 < len({c for _, c in want.values()}) < 1_000
    same(neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 4, 80).collect(), want)


def test_blocks_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)
    rows = near_copies(random.Random(4), 3, 150, 60, 6)
    same(neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 4, 80).collect(), brute(rows, 4, 80))


def test_null_and_repeated_ids(spark):
    text = "w1 w2 w3 w4 w5 w6 w7"
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text + "!"), (7, text), (None, "only null ids here, all of them"), (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.cluster(df, 4, 80).collect()), key=str)
    alone = ("only null ids here, all of them".count(" ") + 1) - 3
    assert got == sorted([(None, 4, 5, False), (5, 4, 5, True), (5, 4, 5, True), (7, 4, 7, True), (7, 4, 5, False), (None, alone, None, True), (None, 0, None, True)], key=str)
    assert neardup.cluster(df.limit(0)).count() == 0
    assert neardup.keep_first(df.where("doc_id is not null").withColumn("n", df.doc_id), shingle_words=4).columns == ["doc_id", "text", "n"]


def test_keep_first_decides_by_row(spark):
    text = "w1 w2 w3 w4 w5 w6 w7"
    rows = [(5, text), (None, text), (7, text + "!"), (7, text), (7, ""), (7, None)] + [(None, f"clean row {i} of its own words, {i} {i} {i}") for i in range(20)] + [(None, None), (None, "")]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([r for r in rows if r not in [(None, text), (7, text)]], key=str)


@pytest.mark.parametrize("one_id", [None, 7])
def test_one_id_on_many_texts(spark, one_id):
    """Representatives are found by id and text: as many rows as classes, not their square."""
    n = 4_000
    docs = spark.range(n).select(F.lit(one_id).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(c), F.col("id").cast("string")) for c in "abcdef")).alias("text"))
    classes = neardup.classes_of(neardup.features(docs, 4)).cache()
    assert neardup.texts_of(docs, classes, classes.select("cid")).count() == n
    some = classes.limit(50).select("cid")
    assert neardup.full_sets(docs, classes, some, 4).count() == 50
    rows = [(one_id, f"{c} x{i} y{i} z{i} v{i} u{i} t{i} s{i} r{i} q{i} p{i} o{i}") for i in range(60) for c in ("first", "other")] + [(3, "x1 y1 z1 v1 u1 t1 s1 r1 q1 p1 o1")]
    got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2, percent=80).collect()
    by_row, ids = brute([(k, t) for k, (_, t) in enumerate(rows)], 2, 80), {}
    for k, (_, root) in by_row.items():
        ids.setdefault(root, []).append(rows[k][0])
    least = {root: min((i for i in own if i is not None), default=None) for root, own in ids.items()}
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(((rows[k][0], m, least[root]) for k, (m, root) in by_row.items()), key=repr)


def test_recall_is_planned():
    rng = np.random.default_rng(0)
    trees, found = neardup.trees_for(0.99, 0.8), 0
    for _ in range(200):
        sig = rng.integers(0, 2**32, (2, neardup.COORDINATES), dtype=np.uint32)
        same_at = rng.random(neardup.COORDINATES) < 0.8
        sig[1, same_at] = sig[0, same_at]
        paths = []
        for row in (0, 1):
            rows, p = np.full(trees, row), neardup.mixed(np.arange(1, trees + 1, dtype=np.uint64))
            for _ in range(neardup.MOST_DEPTH):
                rows, p = neardup.step(rows, p, sig)
            paths.append(set(p.tolist()))
        found += bool(paths[0] & paths[1])
    assert found >= 190


def test_trees_share_coordinates():
    rng, trees, missed, pairs = np.random.default_rng(2), neardup.trees_for(neardup.RECALL, 0.8), 0, 6_000
    for _ in range(pairs):
        sig = rng.integers(0, 2**32, (2, neardup.COORDINATES), dtype=np.uint32)
        same_at = rng.random(neardup.COORDINATES) < 0.8
        sig[1, same_at] = sig[0, same_at]
        ends = []
        for row in (0, 1):
            rows, p = np.full(trees, row), neardup.mixed(np.arange(1, trees + 1, dtype=np.uint64))
            for _ in range(neardup.MOST_DEPTH):
                rows, p = neardup.step(rows, p, sig)
            ends.append(p)
        missed += not np.intersect1d(*ends).size
    assert missed <= 3  # 0.6 expected
    assert neardup.trees_for(neardup.RECALL, 1.0) == 1
    with pytest.raises(ValueError):
        neardup.trees_for(neardup.RECALL, 0.1)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op5_near_duplicates"](spark, d).collect(), brute(rows, 4, 80))


def test_texts_are_shuffled_once(spark, monkeypatch):
    """However many levels branch: every level's classes are among the first one's."""
    made, levels = [], []
    texts_of, nodes_of = neardup.texts_of, neardup.nodes_of
    monkeypatch.setattr(neardup, "texts_of", lambda *a: made.append(1) or texts_of(*a))
    monkeypatch.setattr(neardup, "nodes_of", lambda rows: levels.append(1) or nodes_of(rows))
    monkeypatch.setattr(neardup, "NODE", 8)
    rows = near_copies(random.Random(6), 2, 150, 60, 6)
    same(neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 4, 80).collect(), brute(rows, 4, 80))
    assert len(levels) > 2 and len(made) == 1


def test_set_of_overlapping_groups_is_sent_once(spark, monkeypatch):
    """Groups that share a class are one, and one for each if that is larger than a leaf; what has no class in common stays apart."""
    monkeypatch.setattr(neardup, "NODE", 4)
    blocks = {100: [1, 2], 101: [2, 3, 4], 102: [1, 4], 103: [7, 8], 104: [11, 12, 13], 105: [13, 14, 15]}
    chosen = spark.createDataFrame([(b, c, -c) for b, cids in blocks.items() for c in cids], "block long, cid long, label long")
    classes = spark.createDataFrame([(c, 10) for c in range(20)], "cid long, n long")
    got = {}
    for r in neardup.joined_groups(neardup.Workspace(spark, "t"), chosen, classes).collect():
        assert r.label == -r.cid
        got.setdefault(r.block, []).append(r.cid)
    assert sorted(sorted(x) for x in got.values()) == [[1, 2, 3, 4], [7, 8], [11, 12, 13], [13, 14, 15]]
