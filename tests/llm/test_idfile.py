"""Id files against the tokenizers library: exact round trips, starts and checksums."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from shelfwatch.llm import idfile
from shelfwatch.llm.queries import QUERIES

TOKENIZER = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 129, 1000, 70_000])
@pytest.mark.parametrize("high", [1, 2, 300, 49_408])
def test_coder(n, high):
    ids = np.random.default_rng(n).integers(0, high, n)
    assert (idfile.uncode_ids(idfile.code_ids(ids, 49_408), n, 49_408) == ids).all()


def test_coder_learns():
    ids = np.tile(np.random.default_rng(1).integers(0, 49_408, 500), 100)
    assert sum(map(len, idfile.code_ids(ids, 49_408))) < 0.4 * 2 * len(ids)


def test_damage_is_found():
    ids = np.arange(5000) % 77
    block = idfile.write_block([(3, 2000, 0), (None, 3000, 0)], ids, 9, 49_408)
    docs, got, start = idfile.read_block(block)
    assert docs == [(3, 2000, 0), (None, 3000, 0)] and (got == ids).all() and start == 9
    for at in (0, 30, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            idfile.read_block(block[:at] + bytes([block[at] ^ 255]) + block[at + 1 :])
    with pytest.raises(ValueError):
        idfile.read_block(block[:-3])


def test_crc_combine():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = rnd.randbytes(rnd.randrange(99)), rnd.randbytes(rnd.randrange(99))
        assert idfile.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected(tokenizer, rows):
    """{doc_id: (start, n, crc)} of rows with distinct ids."""
    out, at = {}, 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out[i] = at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    return out


@pytest.mark.parametrize("block, piece", [(1 << 18, 200_000), (50, 40)])
def test_round_trip(spark, tokenizer, monkeypatch, block, piece):
    monkeypatch.setattr(idfile, "BLOCK", block)
    monkeypatch.setattr(idfile, "PIECE", piece)
    rows = [(None, "null id"), *enumerate(["", None, "Some Words, and others!", "<|endoftext|> é中文😀\x1c x", "long " * 3000, "it's \t\n  ﬁ", "a" * 700, "exactly " * 49, "word " * 99])]
    df = spark.createDataFrame([("clash", *r) for r in rows], "start string, doc_id long, text string").repartition(3)
    got = idfile.round_trip(df, TOKENIZER).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == expected(tokenizer, rows)
    assert idfile.round_trip(df.limit(0), TOKENIZER).count() == 0


def test_ids_of_words_are_those_of_the_text(tokenizer, monkeypatch):
    rnd = random.Random(5)
    odd = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + list("\uac00\u1100\u1161\ufb01\ufeff\U0001f600\U00010400\u4e2d")
    texts = [f"a{c}b {c} {c}{c} it's{c}D\t{c}\u0301 e\u0301{c}" for c in odd]
    texts += ["".join(rnd.choice([*" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003", "'s", "'Re", "1", "word", "\u0301", "<|endoftext|>", "\u03a3", "\u0130", "!", rnd.choice(odd)]) for _ in range(30)) for _ in range(3_000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for kept in (idfile.KEPT_WORDS, 50):
        monkeypatch.setattr(idfile, "KEPT_WORDS", kept)
        words = idfile.WordIds(tokenizer)
        got = [x.tolist() for at in range(0, len(texts), 500) for x in words.encode(texts[at : at + 500])]
        assert got == want
    assert [x.tolist() for x in words.encode(["", "  "])] == [[], []]


def test_mixing_beats_single_orders():
    """Ids that order 2 tells, order 1 tells and order 0 tells, by turns, each far below its plain cost."""
    rng = np.random.default_rng(3)
    follows = rng.integers(0, 5_000, 5_000)
    ids = [0]
    for _ in range(150_000):
        ids.append(int(follows[ids[-1]]) if rng.random() < 0.8 else int(5_000 * rng.random() ** 4))
    ids = np.array(ids)
    count = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    plain = -(count * np.log2(count)).sum()
    assert 8 * sum(map(len, idfile.code_ids(ids, 49_408))) / len(ids) < 0.62 * plain


def test_pieces_join():
    text = "some words\tand\nothers " * 30_000
    assert " ".join("".join(p) for p in idfile.pieces_of(text)).split() == text.split()


def test_repeated_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c")]
    got = sorted((r.doc_id, r.start) for r in idfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect())
    assert got == [(1, 0), (1, 2), (1, 4), (2, 6)]


def test_query(spark, sf, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_id_files"](spark, sf).collect()} == expected(tokenizer, rows)


def test_new_words_go_to_the_library_together(tokenizer):
    """Also such that give the id that stands between words, or hold a special token; by twos and threes, and alone."""
    given = []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return tokenizer.encode_batch_fast(texts, **kw)

    words = idfile.WordIds(Counted())
    plain = [f"w{i} Straße{i} don't{i} é{i} {i}.&&& \U0001f600{i}" for i in range(500)]
    assert [x.tolist() for x in words.encode(plain)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in plain]
    assert len(given) < 0.01 * len(words)
    odd = ["a \x01 b", "\x01", "\x01\x01 x\x01y", "<|endoftext|> z<|startoftext|>q", "́ ́x", "ΣΑΣ Σ", "\x1c \x85x", "one"]
    for some in (odd, *([t] for t in odd), odd[::-1] + plain[:3]):
        words.forget()
        assert [x.tolist() for x in words.encode(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]


class Given:
    """A tokenizer that notes what it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **kw):
        self.texts.extend(texts)
        return self.tokenizer.encode_batch_fast(texts, **kw)


def test_pieces_go_to_the_library_once(tokenizer):
    """Words that differ in case and in what stands around them share their pieces."""
    whole, pieces = Given(tokenizer), Given(idfile.cut_tokenizer(tokenizer))
    words = idfile.WordIds(whole, pieces)
    whole.texts.clear()
    texts = [f"straße{i}x Straße{i}x, (straße{i}x) 'STRAßE{i}X'! straße{i}x's..." for i in range(10, 400)]
    assert [x.tolist() for x in words.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    met = " ".join(pieces.texts).split(" ")
    assert not whole.texts and len(met) == len(set(met)) < 30


def test_ids_by_pieces_are_those_of_the_text(tokenizer, monkeypatch):
    rnd = random.Random(6)
    plain = [chr(c) for c in range(0x21, 0x180) if not 0x7F <= c < 0xA1]
    bits = [*" \t\n\r\x0b\x0c\x1c\x85\xa0", "'s", "'Re", "'LL", "don't", "́", "<|endoftext|>", "<|", "|>", "</w>", "\x01", "Σ", "İ", "ÄÖÜß", "é", "²"]
    texts = ["".join(rnd.choice([*bits, rnd.choice(plain), rnd.choice(plain)]) for _ in range(rnd.randrange(40))) for _ in range(6_000)]
    texts += [f"a{c}b {c} {c}{c} it's{c}D\t{c}S {c}'s" for c in map(chr, range(1, 0x500))] + ["", " ", "x" * 3_000, "Ab1" * 900]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for kept in (idfile.KEPT_WORDS, 50):
        monkeypatch.setattr(idfile, "KEPT_WORDS", kept)
        words = idfile.WordIds(tokenizer, idfile.cut_tokenizer(tokenizer))
        got = [x.tolist() for at in range(0, len(texts), 400) for x in words.encode(texts[at : at + 400])]
        assert got == want


def test_only_its_own_kind_of_tokenizer_is_cut():
    from tokenizers import Tokenizer

    assert idfile.cut_tokenizer(Tokenizer.from_file(P.path("byte_bpe_50k.json"))) is None


def test_a_lane_is_put_twice_a_step_at_most(monkeypatch):
    """Once for which prediction came true, and for its id where none did."""
    put, lanes = idfile.Encoder.put, []
    monkeypatch.setattr(idfile.Encoder, "put", lambda self, at, first, *rest: (lanes.append(len(first)), put(self, at, first, *rest)))
    ids = np.random.default_rng(4).integers(0, 400, 50_000) ** 2 // 400
    streams = idfile.code_ids(ids, 49_408)
    assert sum(lanes) <= 2 * len(ids)
    assert (idfile.uncode_ids(streams, len(ids), 49_408) == ids).all()
