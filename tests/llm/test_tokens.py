"""BPE and token counts against the libraries themselves."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import Row

from shelfwatch.llm import bpe, token_counts
from shelfwatch.llm.queries import QUERIES

RANKS, MODEL = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "a" * 3000, "\n\n  \t x", "naïve ﬁ 中文 😀 ’s it's", "\u0000́", "<|endoftext|> <s>", " ".join(["word"] * 9000), "▁ ▁▁ x"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_bpe_equals_library(reference):
    c = bpe.codec(RANKS, P.PATTERN)
    rnd = random.Random(3)
    for text in [*ODD, *("".join(rnd.choice("aab é中'st1\n.") for _ in range(n)) for n in (3, 40, 400, 4000) for _ in range(20))]:
        assert c.encode(text) == reference.encode_ordinary(text)
        assert c.decode(packed(c.encode(text))) == text.encode()


@pytest.mark.parametrize("typed", [False, True])
def test_rank_queue_order(typed):
    q, rnd, held = bpe.RankQueue(50_000, typed), random.Random(1), []
    for _ in range(5000):
        r = rnd.randrange(50_000)
        q.push(r, [rnd.randrange(1000)])
        held.append(r)
    got = []
    while x := q.pop():
        got.append(x[0])
        assert list(x[1]) == sorted(x[1])
    assert got == sorted(set(held)) and not q.top


def test_very_long_pre_tokens(reference):
    """As the library gives them, in some 25 bytes of memory for each of theirs."""
    import tracemalloc

    c, rnd = bpe.codec(RANKS, P.PATTERN), random.Random(2)
    for text in ("".join(rnd.choices("abcdeé", k=400_000)), "a" * 400_001, "ab" * 150_000):
        ids = c.merge([text.encode()])[0]
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and c.decode(ids) == text.encode()
    assert c.long_queue is not None and not c.long_queue.top
    piece = "".join(rnd.choices("abcdefgh", k=250_000)).encode()
    tracemalloc.start()
    c.merge([piece])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * len(piece), most


def test_long_text_in_runs(reference, monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 50)
    c = bpe.BytePairCodec(bpe.load_ranks(RANKS), P.PATTERN)
    text = "some words, others; " * 2000
    assert list(np.frombuffer(b"".join(c.stream(text)), "<u4")) == reference.encode_ordinary(text)


def docs(spark, texts):
    return spark.createDataFrame([Row(text=t, ids=[1], doc_id=i, n_tokens="x") for i, t in enumerate(texts)], "text string, ids array<int>, doc_id long, n_tokens string")


def test_documents(spark, reference, model):
    df = docs(spark, [*ODD, None, "twice", "twice"]).unionByName(spark.createDataFrame([("no id", None, None, None)], "text string, ids array<int>, doc_id long, n_tokens string"))
    rows = [r for r in bpe.encode_documents(df, RANKS, P.PATTERN).collect() if r.doc_id is not None]
    counts = {r.doc_id: r for r in token_counts.count_tokens(df, MODEL, chunk=40, overlap=8).collect()}
    assert len(rows) == len(ODD) + 3 and len(counts) == len(ODD) + 4 and None in counts
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
        n = len(model.encode(texts[r.doc_id]))
        assert counts[r.doc_id][1:] == (len(texts[r.doc_id].encode()), n, n > 4096)
    back = bpe.decode_documents(bpe.encode_documents(df, RANKS, P.PATTERN, keep_ids=True), RANKS, P.PATTERN).where("doc_id is not null").collect()
    assert all(texts[r.doc_id] == r.text for r in back)


def test_empty_table(spark):
    df = docs(spark, ["x"]).limit(0)
    assert bpe.encode_documents(df, RANKS, P.PATTERN).count() == 0 and token_counts.count_tokens(df, MODEL).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(20, 4), (50, 8), (300, 32)])
def test_chunks_splice(model, chunk, overlap):
    c, rnd = token_counts.PieceCounter(MODEL, chunk, overlap), random.Random(chunk)
    assert c.exact
    for n in (5, 300, 900):
        for _ in range(60):
            text = "".join(rnd.choice(["a", "b", " ", "  ", "the", "▁", "é", "中", "\n", "\t", "<s>", "😀", " and"]) for _ in range(n))
            assert c.count(text) == len(model.encode(text))
    assert c.count("x" * 5000) == len(model.encode("x" * 5000)) and c.count(" " * 999) == len(model.encode(" " * 999))


def test_queries(spark, sf, reference, model):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op1_byte_bpe"](spark, sf).collect():
        assert r.ids_sha256 == hashlib.sha256(packed(reference.encode_ordinary(texts[r.doc_id]))).hexdigest()
    for r in QUERIES["op7_token_counts"](spark, sf).collect():
        assert r.n_tokens == len(model.encode(texts[r.doc_id]))
