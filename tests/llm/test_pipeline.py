"""Each stage of the pipeline against brute force on its own input."""

import hashlib

import numpy as np
import public_tokenizers as P
from test_neardup import brute as near_brute
from test_secrets import brute as secret_brute

import corpus_pipeline
from shelfwatch.llm import bpe, decontaminate, rules


def masked(text):
    out, at = [], 0
    for _, a, b in secret_brute(text):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_stages(spark):
    import tiktoken

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, now = docs.columns, docs
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, d)
        rows = {r.doc_id: r for r in now.collect()}
        if name != "token_ids":
            assert now.columns == columns
            now = spark.createDataFrame(list(rows.values()), docs.schema)
        if name == "quality":
            scores = rules.score_documents(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()
            assert set(rows) == {r.doc_id for r in scores if r.predicted == 1}
        elif name == "near_duplicates":
            assert set(rows) == {i for i, (_, c) in near_brute([(i, r.text) for i, r in before.items()], 5, 80).items() if i == c}
        elif name == "benchmark_passages":
            plain = [" ".join(map(decontaminate.bare, r.text.split())) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            hit = {i for i, r in before.items() if any(t in " ".join(w for w in map(decontaminate.bare, r.text.split()) if w) for t in plain)}
            assert hit and not hit & set(rows) and len(before) - len(rows) <= len(hit) + 2
        elif name == "secret_scan":
            assert {i: r.text for i, r in rows.items()} == {i: masked(r.text) for i, r in before.items()}
            assert all(r.n_chars == len(r.text) for r in rows.values())
        else:
            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
            for i, r in rows.items():
                assert r.ids_sha256 == hashlib.sha256(np.array(enc.encode_ordinary(before[i].text), dtype="<u4").tobytes()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, d).collect()} == {i: r.ids_sha256 for i, r in rows.items()}


def test_nulls_and_empty(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]
    odd = spark.createDataFrame(rows, docs.schema)
    scores = rules.score_documents(odd, spark.read.parquet(f"{d}/labels.parquet")).collect()
    good = sum(r.predicted for r in scores)
    assert len(scores) == 3 and good in (0, 3)
    for name, stage in corpus_pipeline.STAGES:
        got = sorted(map(tuple, stage(spark, odd, d).collect()), key=str)
        if name == "token_ids":
            none = hashlib.sha256(b"").hexdigest()
            assert got == sorted([(i, 0, none, none) for i in (None, 1, 1)], key=str)
        else:
            assert got == sorted(rows if name != "quality" or good else [], key=str)
        assert stage(spark, docs.limit(0), d).collect() == []


def test_repeated_and_null_ids(spark):
    """Every stage judges a row by its own text, whatever other rows have its id."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    item = spark.read.parquet(f"{d}/benchmark.parquet").first().text
    copy, long = "one two three four five six seven eight nine ten", "words of a quite different text, told once and only here, number"
    texts = [copy, copy, f"{long} 1", f"{long} 1 and {item} then more", "token = 0123456789abcdef0123", f"clean {long}"]
    rows = [(i, t, "en", "s", len(t)) for i in (None, 7) for t in texts]
    odd = spark.createDataFrame(rows, docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    scores = sorted((r.doc_id, r.score) for r in rules.score_documents(odd.where("doc_id = 7"), spark.read.parquet(f"{d}/labels.parquet")).collect())
    kept = stages["quality"](spark, odd, d).collect()
    assert sum(r.doc_id == 7 for r in kept) == sum(s >= 0.7 for _, s in scores) == sum(r.doc_id is None for r in kept)
    near = sorted(tuple(r)[:2] for r in stages["near_duplicates"](spark, odd, d).collect())
    assert near == sorted((7, t) for t in texts)  # null ids are the largest: their copies of what 7 has go
    alone = odd.where("doc_id is null")
    assert sorted(r.text for r in stages["near_duplicates"](spark, alone, d).collect()) == sorted(texts)
    clean = [(r.doc_id, r.text) for r in stages["benchmark_passages"](spark, odd, d).collect()]
    assert sorted(clean, key=str) == sorted([(i, t) for i, t, *_ in rows if item not in t], key=str)
    masks = [(r.doc_id, r.text) for r in stages["secret_scan"](spark, odd, d).collect()]
    assert sorted(masks, key=str) == sorted([(i, masked(t)) for i, t, *_ in rows], key=str)
    assert len(stages["token_ids"](spark, odd, d).collect()) == len(rows)
