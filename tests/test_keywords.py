"""Keyword tables against a search for each keyword."""

import random

import pytest

from shelfwatch.operators import keywords


def check(spark, rows, words):
    df = spark.createDataFrame(rows, "id int, text string, source string")
    got = keywords.with_hits(df.repartition(3), df["text"], df["source"], spark.createDataFrame(words, "source string, keyword string"))
    want = {i: sorted({w for s, w in words if w and t and w in t and s in (None, source)}) for i, t, source in rows}
    assert {r.id: r.hits for r in got.collect()} == want
    return got


@pytest.mark.parametrize("at_once", [100_000, 700])
def test_ten_thousand(spark, monkeypatch, at_once):
    monkeypatch.setattr(keywords, "AT_ONCE", at_once)
    rnd = random.Random(5)
    words = [(rnd.choice(["a", "b", None]), "".join(rnd.choices("abcdé ", k=rnd.randint(2, 7)))) for _ in range(10_000 if at_once > 1000 else 2_000)]
    rows = [(i, "".join(rnd.choices("abcdé ", k=60)), rnd.choice(["a", "b", "c", None])) for i in range(60)]
    got = check(spark, rows, words)
    if at_once > 1000:
        assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_odd(spark):
    check(spark, [(1, None, "a"), (2, "", "a"), (3, "he she hers", None), (4, "she", "a"), (5, "😀x", "b")], [("a", "he"), (None, "she"), ("a", "hers"), ("b", "😀"), ("a", ""), ("a", None), ("a", "he"), ("b", "he")])
    check(spark, [(1, "x", "a")], [])
