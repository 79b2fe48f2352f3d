"""Planted benchmark passages, exact and edited, against a brute-force edit distance."""

import random

import numpy as np

from shelfwatch.llm import decontaminate as d
from shelfwatch.llm.queries import QUERIES


def slow(item, text):
    """Least word edits between item and any part of text."""
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (t != w), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_distance():
    rnd = random.Random(1)
    for _ in range(200):
        item, text = [rnd.randrange(4) for _ in range(rnd.randrange(1, 9))], [rnd.randrange(4) for _ in range(rnd.randrange(0, 20))]
        got, start = d.distance(np.array(item), np.array(text, dtype=int))
        assert got == slow(item, text)
        assert slow(item, text[start:]) == got


def words_of(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([2, 3, 5, 7]))) for _ in range(n)]


def planted(rnd, ws, edits):
    out = list(ws)
    for _ in range(edits):
        at, kind = rnd.randrange(len(out)), rnd.randrange(3)
        out[at : at + (kind != 1)] = ["zzz"] if kind < 2 else []
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    items = [(i, words_of(rnd, rnd.choice([6, 9, 20, 45, 100]))) for i in range(30)]
    docs = []
    for i in range(160):
        text = words_of(rnd, rnd.randrange(0, 120))
        if i % 2:
            _, ws = rnd.choice(items)
            text[:0] = planted(rnd, ws, rnd.randrange(int(0.4 * len(ws)) + 1))
            rnd.shuffle(text) if i % 10 == 9 else None
        docs.append((i, " ".join(w.upper() + rnd.choice(["", ".", "!"]) for w in text)))
    docs += [(500, None), (501, ""), (None, " ".join(items[0][1])), (502, " ".join(items[1][1])), (502, " ".join(items[1][1])), (503, "long " * 100_000 + " ".join(items[2][1]))]
    bench = spark.createDataFrame([("x", i, " ".join(ws)) for i, ws in items] + [("x", 90, None), ("x", 91, ""), ("x", 92, "the of"), ("x", None, " ".join(items[3][1]))], "doc_id string, item_id long, text string")
    df = spark.createDataFrame([(1, *r) for r in docs], "item_id long, doc_id long, text string")
    got = d.find_benchmark(df, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got if r.item_id is not None}
    true = {}
    for i, text in docs[:160]:
        ws = [d.bare(w) for w in text.split()]
        for k, item in items:
            if (e := slow(item, ws)) <= int(d.MAX_EDIT * len(item)):
                true[i, k] = e
    assert {(i, k) for i, k in pairs if i is not None and i < 500} <= set(true)
    assert len(set(true) - pairs) <= 0.02 * len(true) and len(true) > 25
    assert all(true[r.doc_id, r.item_id] == r.edits for r in got if r.item_id is not None and r.doc_id is not None and r.doc_id < 500)
    assert {(None, 0), (502, 1), (503, 2)} <= pairs and sum(r.doc_id == 502 for r in got) == 2
    assert any(r.item_id is None for r in got) == any(k == 3 for _, k in true)
    kept = d.remove_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in pairs} - {r.doc_id for r in got}


def test_remove_decides_by_row(spark):
    item = " ".join(words_of(random.Random(6), 20))
    rows = [(i, t) for i in (None, 7) for t in (f"before {item} after", "clean text", "", None)]
    kept = d.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEM_BYTES", 200)
    rnd = random.Random(5)
    items = [(i, " ".join(words_of(rnd, 12))) for i in range(6)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(items, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.edits) for r in d.find_benchmark(docs, bench).collect()} == {(i, i, 0) for i in range(6)}
    assert d.find_benchmark(docs.limit(0), bench).count() == 0 and d.find_benchmark(docs, bench.limit(0)).count() == 0


def all_pairs(items, docs):
    """{(document, item): edits} by brute force."""
    out = {}
    for i, text in docs:
        ws = [w for t in d.tokens_of(text) if (w := d.bare(t))]
        for k, item in items:
            ps = [w for t in d.tokens_of(item) if (w := d.bare(t))]
            if ps and (e := slow(ps, ws)) <= int(d.MAX_EDIT * len(ps)):
                out[i, k] = e
    return out


def test_short_items_without_loss():
    rnd = random.Random(7)
    items = [(i, " ".join(f"w{rnd.randrange(12)}" for _ in range(1 + i % 7))) for i in range(40)] + [(90, " ".join(words_of(rnd, 30))), (91, "--- ...")]
    docs = [(i, " ".join(rnd.choice([f"w{rnd.randrange(14)}", f"other{rnd.randrange(9)}", "-"]) for _ in range(rnd.randrange(0, 14)))) for i in range(300)]
    docs += [(400 + j, f"a b {' '.join(planted(rnd, t.split(), j % 2))} c d") for j, (_, t) in enumerate(items)]
    want = all_pairs(items, docs)
    found = d.Sieve(items).find([t for _, t in docs])
    assert {(docs[i][0], k): e for i, k, e, _, _ in found} == want and len(want) > 200
    assert d.Sieve([(1, "one two"), (2, None), (3, "")]).find(["one two", "", "ONE, two!", "two one"]) == [(0, 1, 0, 2, 0), (2, 1, 0, 2, 0)]


def test_scripts_without_blanks():
    item = "\u4eca\u5929\u7684\u5929\u6c14\u975e\u5e38\u597d\u6211\u4eec\u53bb\u516c\u56ed\u73a9\u5427"
    texts = [f"\u524d\u6587{item}\u540e\u6587", f"x {item[:7]}\u5f88{item[8:]} y", "\u6211\u4eec\u53bb\u4e0a\u73ed", item[::-1]]
    assert [(i, e) for i, _, e, _, _ in d.Sieve([(1, item)]).find(texts)] == [(0, 0), (1, 1)]


def test_lengths_beyond_the_walks_are_verified_whole(monkeypatch):
    monkeypatch.setattr(d, "MOST_WALKS", 0)
    rnd = random.Random(8)
    items = [(i, " ".join(words_of(rnd, 10 + i))) for i in range(12)]
    docs = [(i, " ".join(words_of(rnd, 30) + planted(rnd, items[i % 12][1].split(), i % 4) + words_of(rnd, 20))) for i in range(60)]
    sieve = d.Sieve(items)
    assert set(sieve.walks.values()) == {0}
    assert {(i, k): e for i, k, e, _, _ in sieve.find([t for _, t in docs])} == all_pairs(items, docs)


def test_each_length_has_its_walks():
    rnd = random.Random(9)
    sieve = d.Sieve([(i, " ".join(words_of(rnd, n))) for i, n in enumerate([8] * 3 + [12] * 50 + [60] * 5)])
    assert set(sieve.walks) == {8, 12, 60} and all(sieve.walks.values())
    missed = 0
    for n in sieve.walks:
        for t in range(200):
            k = sieve.by_length[n][t % len(sieve.by_length[n])]
            words = [next(w for w, x in sieve.vocabulary.items() if x == y) for y in sieve.items[k][1].tolist()]
            missed += not any(i == sieve.items[k][0] for _, i, *_ in sieve.find([" ".join(planted(rnd, words, sieve.edits(n)))]))
    assert missed <= 9  # 3 expected


def test_query(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    plain = [(r.item_id, " ".join(map(d.bare, r.text.split()))) for r in items]
    exact = {(r.doc_id, i) for r in docs for i, t in plain if t in " ".join(w for w in map(d.bare, (r.text or "").split()) if w)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_passages"](spark, sf).collect()}
    assert exact <= got and len(got) <= len(exact) + 3
