"""Merkle proofs against a plain build of the trees."""

import hashlib
import random
import string
import zlib

import pytest

from shelfwatch.llm import merkle

SCHEMA = "idx long, doc_id long, text string, lang string, source string, n_chars long, hash string, tree int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, i, cur, proof):
    for nodes in levels[:-1]:
        run = list(range(i - i % 8, min(i - i % 8 + 8, len(nodes))))
        proof += "".join(nodes[j] for j in run if j != i)
        cur = h("".join(cur if j == i else nodes[j] for j in run))
        i //= 8
    return cur, proof


def brute(rows):
    by_lang = {}
    for _, i, text, lang, source, n, _, _ in rows:
        lower = text and text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        leaf = leaf_of(i, source, lang, n, text)
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        by_lang.setdefault(lang, []).append((i is not None, i or 0, leaf, leaf_of(i, source, lang, n, lower) if hit else leaf))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(by_lang[g])]) for g in langs}
    top = tree_of([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for at, (known, i, leaf, start) in enumerate(sorted(by_lang[g])):
            cur, proof = climb(trees[g], at, start, "")
            cur, proof = climb(top, k, cur, proof)
            out.append((i if known else None, leaf, trees[g][-1][0], top[-1][0], h(proof), cur, cur == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows):
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def row(i, text, lang="en", source="s", n=1):
    return (7, i, text, lang, source, n, "x", 3)


@pytest.mark.parametrize("counts", [{"en": 600, None: 9, "é": 1, "a": 8, "z": 64}, {f"l{k}": 1 + k % 10 for k in range(70)}, {"en": 4200}])
def test_trees(spark, counts):
    rnd = random.Random(1)
    ids = iter(rnd.sample(range(10**6), sum(counts.values())))
    check(spark, [row(next(ids), rnd.choice(["A b", "none", "", None, "Ünï " * 5]), lang, rnd.choice([None, "s", "ß"]), rnd.choice([None, 4])) for lang, n in counts.items() for _ in range(n)])


def test_repeated_null_and_long(spark):
    check(spark, [row(3, "Same")] * 40 + [row(None, "No id")] * 20 + [row(3, "other"), row(9, "Long " * 200_000), row(None, None, None, None, None)])
    check(spark, [row(9, "Alone")])


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_is_found(spark):
    rows = [row(i, t) for i in range(60) for t in ("Capital", "small")]
    for r, (_, i, text, *_) in zip(sorted(merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), sorted(rows), strict=True):
        assert r.doc_id == i
        assert r.verified == (r.folded_root == r.root)
    bad = [r for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect() if not r.verified]
    assert sorted(r.doc_id for r in bad) == [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 0]
