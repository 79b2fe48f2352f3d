"""The rule ensemble: compiled expressions equal the model, and it ranks rows it hasn't seen."""

import zlib

import numpy as np

from shelfwatch.llm import rules
from shelfwatch.llm.queries import QUERIES


def test_compiled_equals_model(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(float)
    m = rules.fit(x, y, ("a", "b", "c"))
    assert ((m.predict(x) >= 0.5) == y).mean() > 0.97
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = dict(df.select("i", m.score({n: df[n] for n in "abc"}).alias("s")).collect())
    assert np.allclose([got[i] for i in range(600)], m.predict(x))
    assert 0 < len(m.rules) < 120


def test_constant_models():
    for y in (np.zeros(0), np.ones(200), np.zeros(5)):
        m = rules.fit(np.zeros((len(y), 2)), y, ("a", "b"))
        assert not m.rules and np.isfinite(m.bias)


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op9_rule_quality"](spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [x for x in labels if rows[x.doc_id].held_out]
    assert np.mean([rows[x.doc_id].predicted == x.quality for x in held]) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(0.1, None, None), (0.1, 1, ""), (0.1, 1, ""), (0.1, 2, "a b " * 50_000), (0.1, 3, None)], "score double, doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = rules.score_documents(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert rules.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_statistics_against_plain_code(spark):
    import re

    def plain(t):
        words, lines, chars = t.split(), t.split("\n"), max(1, len(t))
        some = max(1, len(words))
        pairs = [m[0] for m in re.finditer(r"(?i)\b([a-z]+)[^A-Za-z0-9_]+\1\b", t)]
        return {
            "chars": len(t), "words": len(words), "word_length": len(t) / some, "upper": sum(c.isupper() for c in t) / chars, "letters": sum(c.isalpha() for c in t) / chars, "digits": sum(c in "0123456789" for c in t) / chars,
            "stops": sum(c in ".?" and (i + 1 == len(t) or t[i + 1].isspace()) for i, c in enumerate(t)) / some, "exclaims": t.count("!") / some, "symbols": sum(c in "#$%&*@^~<>|=+_\\{}[]" for c in t) / some,
            "symbol_runs": sum(len(m) >= 2 for m in re.findall(r"[#$%&*!]+", t)) / some, "bars": t.count("|") / some, "lines": len(lines), "distinct_lines": len(set(lines)) / len(lines),
            "links": (t.count("http://") + t.count("https://") + t.count("www.") + sum(t[i] == "@" and t[i + 1 : i + 2].islower() for i in range(len(t)))) / some, "twice": len(pairs) / some,
        }

    rng = np.random.default_rng(4)
    parts = ["word", "Word", "word word", " ", "\n", ". ", "?", "!", "##", "$", "12", "|", "https://a.b", "www.x", "me@x.y", "The the", "_", "\\", "{}", "a" * 300]
    texts = ["", "\n", " ", "x", "x" * 100_000] + ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r.asDict() for r in df.select("i", *(c.alias(n) for n, c in rules.statistics(df["text"]).items())).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert {n: round(got[i][n], 9) for n in want} == {n: round(float(v), 9) for n, v in want.items()}, t


def test_ties_at_the_threshold_are_good(spark):
    docs = spark.createDataFrame([(i, "some text of a few words") for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in rules.score_documents(docs, labels, threshold=0.5).collect()} == {(0.5, 1)}
    assert rules.keep_good(docs, labels, threshold=0.5).count() == 5 and rules.keep_good(docs, labels, threshold=0.5000001).count() == 0
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = {r.doc_id: r.score for r in rules.score_documents(rows, known).collect()}
    at = sorted(scores.values())[len(scores) // 2]
    assert {r.doc_id for r in rules.keep_good(rows, known, threshold=at).collect()} == {i for i, s in scores.items() if s >= at}


def test_fit_finds_what_a_plain_search_finds():
    """On data that one rule explains, the ensemble is as good as the best single threshold pair of an exhaustive search."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = ((x[:, 0] > 0.3) & (x[:, 1] > -0.2)).astype(float)
    cuts = np.quantile(x, np.linspace(0.05, 0.95, 19), axis=0)
    best = max((((x[:, 0] > a) & (x[:, 1] > b)) == y).mean() for a in cuts[:, 0] for b in cuts[:, 1])
    assert ((rules.fit(x, y, ("a", "b")).predict(x) >= 0.5) == y).mean() >= best - 0.01
