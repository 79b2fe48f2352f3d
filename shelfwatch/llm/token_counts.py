"""Token counts of whole texts, by overlap resynchronisation.

A long text is encoded as overlapping chunks, each with the offsets of its tokens. Two neighbours are spliced at a
boundary in their overlap that both have and that is proven stable: no piece of the vocabulary, of whatever length,
matches the text across it. A BPE merge only ever makes vocabulary pieces, so nothing can be merged across such a
point in any context, and what stands before it doesn't change what comes after. Where the overlap has no such
boundary (a run of blanks, one endless word), it is widened, twofold each time, at last to the rest of the text.

Chunks start at a blank: the blank that the library puts before each text then stands for it, so a chunk is encoded
just as the same characters inside the text are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwatch.llm.common import batch_of, groups_of, keyed_text

CHUNK = 12_000
OVERLAP = 96
BLANK = "▁"

OUTPUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class PieceCounter:
    """Counts tokens as sentencepiece does, without begin or end tokens."""

    def __init__(self, model_path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) for i in range(len(pieces))]
        self.pieces = {p for p, ok in zip(pieces, plain, strict=True) if ok}
        self.longest = max(map(len, self.pieces))
        # UTF-8 bytes that a token covers in the text, a blank counting as one.
        self.width = np.array([len(p.replace(BLANK, " ").encode()) if ok else 1 for p, ok in zip(pieces, plain, strict=True)])
        # Offsets can be told from ids only if the library leaves the text as it is and has an id for every byte.
        probe = "a  bäﬁ ①\t́"
        self.exact = m.normalize(probe) == BLANK + probe.replace(" ", BLANK) and sum(map(m.is_byte, range(len(pieces)))) == 256

    def stable(self, text: str, p: int) -> bool:
        """No vocabulary piece matches across position p."""
        lo, hi = max(0, p - self.longest + 1), min(len(text), p + self.longest - 1)
        around = text[lo:hi].replace(" ", BLANK)
        p -= lo
        return not any(around[i:j] in self.pieces for i in range(p) for j in range(p + 1, min(len(around), i + self.longest) + 1))

    def starts(self, text: str, ids: list[int], skip: int) -> np.ndarray:
        """For each byte of the chunk's text, how many tokens end before it, or -1 where no token begins; skip: 1 if the text lacks its first blank."""
        ends = np.cumsum(self.width[ids]) - skip
        out = np.full(int(ends[-1]) + 1 if len(ends) else 1, -1)
        if len(ends):
            out[ends] = np.arange(1, len(ends) + 1)
        return out

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if len(text) <= self.chunk + self.overlap or not self.exact:
            return len(self.model.encode(text))
        text = text.replace(BLANK, " ")  # to the library they are the same character
        total, a = 0, 0  # chunk [a, b) is encoded from a on; the tokens before a are counted
        while True:
            b, overlap = min(len(text), a + self.chunk + self.overlap), self.overlap
            while True:
                ids = self.model.encode(text[a + (a > 0) : b])
                if b == len(text):
                    return total + len(ids)
                if (cut := self.splice(text, a, b, ids, overlap)) is not None:
                    total += cut[0]
                    a = cut[1]
                    break
                overlap *= 2
                b = min(len(text), b + overlap)

    def splice(self, text: str, a: int, b: int, ids: list[int], overlap: int) -> tuple[int, int] | None:
        """(tokens of chunk [a, b) before p, p) for a blank p in its last characters from which the next chunk can start."""
        first = max(a + 1, b - overlap)
        at = text.find(" ", first, b)
        if at < 0:
            return None
        here = self.starts(text, ids, 1)
        offset = len(text[a + (a > 0) : at].encode())
        after = self.model.encode(text[at + 1 : b])
        there = self.starts(text, after, 1)
        base = offset  # bytes of the chunk before `at`
        p = at
        while 0 <= p < b:
            x = base + len(text[at:p].encode())
            y = x - base - 1  # bytes of the next chunk before p, without its own first blank
            same = x < len(here) and here[x] >= 0 and (p == at or 0 <= y < len(there) and there[y] >= 0)
            if same and self.stable(text, p):
                return int(here[x]), p
            p = text.find(" ", p + 1, b)
        return None


_COUNTERS: dict[tuple, PieceCounter] = {}


def counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    if (path, chunk, overlap) not in _COUNTERS:
        _COUNTERS[path, chunk, overlap] = PieceCounter(path, chunk, overlap)
    return _COUNTERS[path, chunk, overlap]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text, as the library counts them.

    One narrow stage without a shuffle; a row out for each row in, repeated rows and ids included. A null or empty
    text has no bytes and no tokens; a null id stays null; an empty table gives none. Memory holds a chunk's tokens
    besides the text, unless a text has no stable boundary for a long stretch, which is then encoded in one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path, chunk, overlap)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in groups_of(batch, 1):
                n = [c.count(t) if t else 0 for t in texts]
                yield batch_of(OUTPUT, (ids[a:b], [len(t.encode()) for t in texts], n, [x > limit for x in n]))

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
