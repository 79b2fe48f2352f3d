"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The encoder merges the pre-tokens of a whole batch at once: their bytes stand in one linked list with a barrier
between pre-tokens. A bucket for each merge rank holds list positions; three levels of 64-bit words say which
buckets hold something, so find-first-set gives the lowest rank in three steps, however many pairs are waiting. An
entry whose pair has changed since is stale and skipped. Each position enters a bucket once for each pair that
begins there, so a pre-token of n bytes costs O(n) queue operations, which also holds for one of megabytes.

A pre-token that is a vocabulary entry as a whole is that id, and ties go to the leftmost pair, as in tiktoken.
Encoded pre-tokens are kept in a bounded table per worker.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shelfwatch.llm.common import batch_of, groups_of, keyed_text

KEPT_PIECES = 400_000
KEPT_BYTES = 32 << 20
LONG_TEXT = 2_000_000
RUN = 32_000
LONG_RUN = 200_000

OUTPUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
OUTPUT_IDS = OUTPUT.append(pa.field("ids", pa.list_(pa.int32())))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """A priority queue of positions by rank. Words of 64 bits in three levels mark the non-empty buckets. With typed, buckets are arrays of 32-bit numbers: a tenth of a list's memory, somewhat slower."""

    def __init__(self, ranks: int, typed: bool = False):
        if ranks > 1 << 18:
            raise ValueError("more than 2**18 ranks")
        self.low, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0
        self.fresh = (lambda: array("i")) if typed else list
        self.buckets = [self.fresh() for _ in range(ranks)]

    def mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, at: Sequence[int]) -> None:
        """Positions, one at least, to wait in the bucket of a rank."""
        bucket = self.buckets[rank]
        if not bucket:
            self.mark(rank)
        bucket.extend(at)

    def pop(self) -> tuple[int, Sequence[int]] | None:
        """The lowest rank and its positions from left to right."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        w = self.mid[b]
        a = (b << 6) + (w & -w).bit_length() - 1
        w = self.low[a]
        rank = (a << 6) + (w & -w).bit_length() - 1
        self.low[a] = w = w & (w - 1)
        if not w:
            self.mid[b] = w = self.mid[b] & ~(1 << (a & 63))
            if not w:
                self.top &= ~(1 << b)
        positions, self.buckets[rank] = self.buckets[rank], self.fresh()
        if isinstance(positions, list):
            positions.sort()
        else:
            np.frombuffer(positions, np.int32).sort()  # in place
        return rank, positions


class BytePairCodec:
    """Encodes and decodes by a vocabulary of ranks; pattern cuts a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        # The rank of two adjacent tokens is that of their bytes together: every split of every token into two tokens.
        nothing: dict[int, int] = {}
        self.follow = [nothing] * self.size
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None:
                    if self.follow[a] is nothing:
                        self.follow[a] = {}
                    self.follow[a][b] = r
        self.cut = regex.compile(pattern)
        self.queue, self.long_queue = RankQueue(self.size), None
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed as little-endian unsigned 32-bit integers.

        Pieces of more than LONG_RUN bytes together take arrays of 32-bit numbers: symbol, two links and the waiting
        rank are 16 bytes for each byte of text, its place in a bucket 4 to 5 more.
        """
        follow, single = self.follow, self.single
        typed = sum(map(len, pieces)) > LONG_RUN
        if typed and self.long_queue is None:
            self.long_queue = RankQueue(self.size, True)
        queue = self.long_queue if typed else self.queue
        cells = (lambda x: array("i", x)) if typed else list
        sym = cells([-1])
        starts = []
        for p in pieces:
            starts.append(len(sym))
            sym.extend(map(single.__getitem__, p))
            sym.append(-1)
        n = len(sym)
        nxt, prv = cells(range(1, n + 1)), cells(range(-1, n - 1))
        waiting = cells([-1]) * n  # of the pair that begins here, its rank
        buckets, mark = queue.buckets, queue.mark
        left = -1
        for i, right in enumerate(sym):
            if left >= 0 and right >= 0:
                r = follow[left].get(right, -1)
                if r >= 0:
                    waiting[i - 1] = r
                    if not buckets[r]:
                        mark(r)
                    buckets[r].append(i - 1)
            left = right
        while popped := queue.pop():
            rank, positions = popped
            for k, i in enumerate(positions):
                if waiting[i] != rank:
                    continue  # stale
                j = nxt[i]
                after = nxt[j]
                sym[i], waiting[j], nxt[i], prv[after] = rank, -1, after, i
                lower = False
                before = prv[i]
                if (s := sym[before]) >= 0:
                    r = waiting[before] = follow[s].get(rank, -1)
                    if r >= 0:
                        if not buckets[r]:
                            mark(r)
                        buckets[r].append(before)
                        lower = r < rank
                waiting[i] = -1
                if (s := sym[after]) >= 0:
                    r = follow[rank].get(s, -1)
                    if r >= 0:
                        waiting[i] = r
                        if not buckets[r]:
                            mark(r)
                        buckets[r].append(i)
                        lower |= r < rank
                if lower and k + 1 < len(positions):  # a lower rank has come up: the rest waits its turn
                    queue.push(rank, positions[k + 1 :])
                    break
        out = []
        for i in starts:
            ids = array("I")
            while (s := sym[i]) >= 0:
                ids.append(s)
                i = nxt[i]
            out.append(ids.tobytes())
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't kept yet."""
        if len(self.kept) > KEPT_PIECES or self.kept_bytes > KEPT_BYTES:
            self.kept.clear()
            self.kept_bytes = 0
        new, ranks, kept = [], self.ranks, self.kept
        for p in pieces.difference(kept):
            b = p.encode()
            self.kept_bytes += len(b)
            if (r := ranks.get(b)) is not None:
                kept[p] = r.to_bytes(4, "little")
            else:
                new.append((p, b))
        # Barriers and list cells cost some 200 bytes for each byte: runs of at most RUN bytes, a longer piece alone.
        run: list[tuple[str, bytes]] = []
        held = 0
        for x in [*new, None]:
            if run and (x is None or held + len(x[1]) > RUN):
                kept.update(zip((p for p, _ in run), self.merge([b for _, b in run]), strict=True))
                run, held = [], 0
            if x is not None:
                run.append(x)
                held += len(x[1])

    def encode_parts(self, texts: Iterable[list[str]]) -> list[bytes]:
        """Packed ids for each list of pieces."""
        lists = list(texts)
        self.learn(set().union(*lists))
        get = self.kept.__getitem__
        return [b"".join(map(get, x)) for x in lists]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.stream(text)), dtype="<u4").tolist()

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed ids of a long text, a bounded number of pre-tokens at a time."""
        found = (m.group() for m in self.cut.finditer(text))
        while part := list(islice(found, 200_000)):
            yield self.encode_parts([part])[0]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids; of a long run a bounded number at a time, as an id is ten times as large as a Python number."""
        ids = np.frombuffer(packed, dtype="<u4")
        return b"".join(b"".join(map(self.bytes_of.__getitem__, ids[at : at + LONG_RUN].tolist())) for at in range(0, len(ids), LONG_RUN))


_CODECS: dict[tuple, BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One for each worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairCodec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256, with keep_ids also ids.

    One narrow stage: no shuffle, a row out for each row in, repeated rows and ids included. A null or empty text has
    no tokens and the digests of no bytes; a null id stays null; an empty table gives none. Texts of over two million
    characters go through in runs of pre-tokens, so besides the text itself memory holds one run (keep_ids also the ids).
    A single pre-token is one run whatever its length: 16 MB of letters took 222 MB more, 16 MB of one letter 330 MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in groups_of(batch, 1, 1_000_000):
                n, h, d, kept = [], [], [], []
                if len(texts) == 1 and len(texts[0]) > LONG_TEXT:
                    count, hi, hd, all_ids = 0, hashlib.sha256(), hashlib.sha256(), []
                    for part in c.stream(texts[0]):
                        count += len(part) // 4
                        hi.update(part)
                        hd.update(c.decode(part))
                        if keep_ids:
                            all_ids.append(np.frombuffer(part, dtype="<i4"))
                    n, h, d = [count], [hi.hexdigest()], [hd.hexdigest()]
                    kept = [np.concatenate(all_ids)] if all_ids else [[]]
                else:
                    for packed in c.encode_parts(map(c.cut.findall, texts)):
                        n.append(len(packed) // 4)
                        h.append(hashlib.sha256(packed).hexdigest())
                        d.append(hashlib.sha256(c.decode(packed)).hexdigest())
                        if keep_ids:
                            kept.append(np.frombuffer(packed, dtype="<i4"))
                yield batch_of(OUTPUT_IDS, (ids[a:b], n, h, d, kept)) if keep_ids else batch_of(OUTPUT, (ids[a:b], n, h, d))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return keyed_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the text of ids (as encode_documents gives them with keep_ids); bytes that aren't UTF-8 become U+FFFD, null ids ''."""

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            texts = [c.decode(np.asarray(x.as_py() or [], dtype="<u4").tobytes()).decode(errors="replace") for x in batch.column(1)]
            yield batch_of(schema, (batch.column(0).to_pylist(), texts))

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
