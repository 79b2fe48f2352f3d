"""Token-id files coded by an adaptive context-mixing range coder.

A file is a sequence of blocks. Every block starts from an empty model, says of which documents it holds how many
ids, and carries a CRC-32 of its ids and one of its bytes, so each can be read, checked and, if lost, written again by itself.

Inside a block the ids are dealt to lanes, each a stretch of consecutive ids with its own range coder; all lanes
step together and share one model, so a step is a handful of vector operations. For each lane the model knows the
last follower of the two ids before it (order 2), that of the one before it (order 1) and how often each id has come
(order 0). Each order says how likely the follower is to come next, as counted for its state: how sure order 2 is of
it, how sure order 1 is and whether it agrees, how frequent it is. Logistic mixing with weights learned as the
block goes makes one probability of these three, which codes whether the follower comes. If it does not, order 1's own
follower is tried alike with orders 1 and 0, and at last the id is coded by its count, or as a plain number where it
is new. All arithmetic is on integers, and the decoder takes the same steps, so it has the same model.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import BATCH_BYTES, Workspace, batch_of, groups_of, keyed_text

MAGIC = b"IDB2"
BLOCK = 1 << 20
LANES, LANE_LEAST = 8192, 64
HALF, WORD = np.uint64(32), np.uint64(1 << 32)
ORDER2_BITS = 18
SURE = 7  # the most a prediction's confidence counts
#: How sure a prediction is after it failed, by how sure it was before (under 2 it is given up), and after it came true.
AFTER = np.array([*(k >> 1 for k in range(8)), *(min(k + 1, SURE) for k in range(8))], np.int32)
ONE = 1 << 16  # a probability of 1
PROBABILITY, SPARE = np.uint64(16), np.uint64(8)
SHARE = np.uint64(1 << 24)  # of a lane's range, before it is dealt to what may come
LEVELS = 32  # of order 0's frequencies: half powers of two
RATE = 14  # by which power of two the mixing weights' mean gradient is divided, less two
EACH, EVERY = 32, 4  # steps after each of which the mixers learn, and how often from then on
PIECE = 200_000
KEPT_WORDS, KEPT_CHARS = 700_000, 32 << 20
END = "</w>"
#: What the tokenizer does to a text, as its file says it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The same for words of ASCII and Latin-1 letters in lower case, ended by newlines; and what makes a word other than those: a further character, or a special token's beginning.
CUT = re.compile(r"[a-zß-öø-ÿ]+|\n|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\na-z0-9ß-öø-ÿ]+")
ODD = r"[^\x21-\x7EÀ-ÖØ-öø-ÿ]|<\|"
TOGETHER, BREAK = 256, "\x01"  # so many new words go to the library as one text, with a word between them that has one id
#: Log odds (256 is 1) of probabilities by 16ths of 1/4096, and probabilities of log odds from -2047.
STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int64)
SQUASH = np.array([min(ONE - 24, max(24, round(ONE / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)


class Odds:
    """How often something came true in each of several states, halved when it gets old."""

    def __init__(self, states: int, hits: int = 1, of: int = 4):
        self.states, self.hits, self.n = states, np.full(states, hits, np.int64), np.full(states, of, np.int64)

    def stretched(self) -> np.ndarray:
        return STRETCH[(self.hits << 12) // self.n]

    def learn(self, hits: np.ndarray, of: np.ndarray) -> None:
        self.hits += 8 * hits
        self.n += 8 * of
        old = self.n > 1 << 19
        if old.any():
            self.hits[old], self.n[old] = (self.hits[old] + 1) >> 1, (self.n[old] + 3) >> 1


class Mixer:
    """One probability from the log odds of several orders: their weighted sum, with a set of weights for each kind of context.

    Lanes in the same states of all orders get the same probability, so it is made, and learned from, once for each joint
    state: a row for those of the higher orders, a column for order 0's.
    """

    def __init__(self, orders: list[Odds], order0: Odds, use: np.ndarray):
        """use: the set of weights by row."""
        self.orders, self.order0, self.use, self.sets = orders, order0, use, int(use.max()) + 1
        self.states = np.indices([o.states for o in orders]).reshape(len(orders), -1)
        self.seen = 0
        self.size = len(use) * order0.states
        self.weights = np.full((self.sets, len(orders) + 1), (ONE * 6 // 10), np.int64)

    def mix(self) -> None:
        """Make the probability by joint state."""
        weights = self.weights[self.use]
        self.inputs, self.column = [o.stretched()[x] for o, x in zip(self.orders, self.states, strict=True)], self.order0.stretched()
        rows = sum(x * weights[:, k] for k, x in enumerate(self.inputs))
        dot = (rows[:, None] + weights[:, -1:] * self.column) >> 16
        self.p = SQUASH.take(dot + 2047, mode="clip")

    def see(self, state: np.ndarray, hit: np.ndarray) -> None:
        """Count the lanes that missed and those that hit, by joint state, until they are learned from."""
        self.seen = self.seen + np.bincount(state + hit * np.int32(self.size), minlength=2 * self.size)

    def learn(self) -> None:
        """Down the coding cost's gradient, by its mean over the lanes; sums of integers in doubles are exact."""
        (missed, hits), self.seen = self.seen.reshape(2, len(self.use), -1), 0
        of = missed + hits
        error = (hits * ONE - of * self.p).astype(float)
        n, by_row = of.sum(axis=1), error.sum(axis=1)
        means = np.bincount(self.use, weights=n, minlength=self.sets).astype(np.int64) + 16
        for k, x in enumerate([by_row * x for x in self.inputs] + [error @ self.column.astype(float)]):
            slope = np.bincount(self.use, weights=x, minlength=self.sets).astype(np.int64)
            self.weights[:, k] += (slope // means) >> (RATE - 2)
        hit = hits.sum(axis=1)
        for o, x in zip(self.orders, self.states, strict=True):
            o.learn(*(np.bincount(x, weights=w, minlength=o.states).astype(np.int64) for w in (hit, n)))
        self.order0.learn(hits.sum(axis=0), of.sum(axis=0))


def bit(mask: np.ndarray, at: int) -> np.ndarray:
    return mask.view(np.int8).astype(np.int32) << at


class Model:
    """What both sides know about a block so far. A prediction is one number: id * 8 + how sure; the vocabulary's size stands for no id."""

    def __init__(self, vocabulary: int):
        self.size = vocabulary
        self.none = np.int32(vocabulary * 8)
        self.follow1 = np.full(vocabulary + 1, self.none, np.int32)
        self.follow2 = np.full(1 << ORDER2_BITS, self.none, np.int32)
        has2, same = np.indices((9, 17)).reshape(2, -1) < [[8], [8]]
        self.first = Mixer([Odds(9), Odds(17)], Odds(LEVELS), has2 * 2 + same)  # of the first candidate, by each order's state
        self.second = Mixer([Odds(8)], Odds(LEVELS), np.zeros(8, np.int64))  # of order 1's own candidate
        self.fresh = Odds(1, 3, 4)
        self.count = np.zeros(vocabulary, np.int64)
        self.steps = 0
        self.snapshot()
        self.mix()

    def mix(self) -> None:
        self.first.mix()
        self.second.mix()
        self.first.p[-1, -1] = 0  # no order has a candidate

    def snapshot(self) -> None:
        """The ids seen so far, with cumulative counts, as order 0 uses them until the next one."""
        self.ids = np.flatnonzero(self.count)
        counts = self.count[self.ids]
        self.cum = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)
        self.place = np.full(self.size, -1, np.int32)
        self.place[self.ids] = np.arange(len(self.ids), dtype=np.int32)
        self.holder = np.repeat(np.arange(len(self.ids), dtype=np.int32), counts)  # which id each count is of
        self.level = np.full(self.size + 1, LEVELS - 1, np.int32)  # the last one is for no id
        total = int(counts.sum())
        bounds = np.array([math.isqrt(total * total >> k) for k in range(LEVELS - 1)])
        self.level[self.ids] = np.searchsorted(-bounds, -counts)

    def predict(self, before2: np.ndarray, before1: np.ndarray) -> np.ndarray:
        """For each lane, given the two ids before (vocabulary size: none), the bounds of SHARE's parts: for the first candidate, order 1's own, a new id, one seen before."""
        self.c1 = before1
        self.c2 = (before2 * 40_503 ^ before1 * 2_971) & ((1 << ORDER2_BITS) - 1)
        self.v1, self.v2 = self.follow1.take(self.c1, mode="clip"), self.follow2.take(self.c2, mode="clip")
        self.s1, self.s2 = self.v1 & 7, self.v2 & 7
        self.p1 = self.v1 >> 3
        none1, none2 = self.v1 >= self.none, self.v2 >= self.none
        p2 = self.v2 >> 3
        self.a = p2 ^ ((p2 ^ self.p1) & -bit(none2, 0))
        self.other = (self.p1 != self.a) & ~none1
        self.x = (((self.s2 | bit(none2, 3)) * 17 + (self.s1 | bit(self.other, 3) | bit(none1, 4))) << 5) + self.level.take(self.a, mode="clip")
        self.y = (self.s1 << 5) + self.level.take(self.p1, mode="clip")
        ends = np.zeros((5, len(before1)), np.uint64)
        np.left_shift(self.first.p.take(self.x, mode="clip").view(np.uint64), SPARE, out=ends[1])
        left = SHARE - ends[1]
        two = left * self.second.p.take(self.y, mode="clip").view(np.uint64) * self.other.view(np.uint8) >> PROBABILITY
        np.add(ends[1], two, out=ends[2])
        left -= two
        if len(self.ids):
            p = min(ONE - 1, max(1, int((self.fresh.hits[0] << 16) // self.fresh.n[0])))
            left = np.minimum(np.maximum(left * np.uint64(p) >> PROBABILITY, np.uint64(1)), left - np.uint64(1))
        np.add(ends[2], left, out=ends[3])
        ends[4] = SHARE
        return ends

    def learn(self, ids: np.ndarray, part: np.ndarray, new: int) -> None:
        """part: in which of SHARE's parts each lane's id was; new: how many in the third."""
        hit, again = part == 0, part == 1
        self.first.see(self.x, hit)
        self.first.seen[[self.first.size - 1, -1]] = 0
        tried = np.flatnonzero(self.other & ~hit)
        self.second.see(self.y[tried], again[tried])
        if self.steps < EACH or self.steps % EVERY == 0:
            self.first.learn()
            self.second.learn()
            self.mix()
        self.fresh.learn(np.array([new]), np.array([np.count_nonzero(part > 1)]))
        fresh = (ids << 3).astype(np.int32)
        for follow, c, v, s in ((self.follow1, self.c1, self.v1, self.s1), (self.follow2, self.c2, self.v2, self.s2)):
            kept = v - s
            follow[c] = (fresh ^ ((fresh ^ kept) & -bit(s > 1, 0))) + AFTER.take(s + bit(kept == fresh, 3), mode="clip")
        np.add.at(self.count, ids, 1)
        self.steps += 1
        if self.steps & (self.steps - 1) == 0 or self.steps % 16 == 0:
            self.snapshot()


def lanes_of(n: int) -> tuple[int, int]:
    """(lanes, steps) for so many ids."""
    lanes = max(1, min(LANES, n // LANE_LEAST))
    return lanes, -(-n // lanes)


def narrowed(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Lanes with under 32 bits of range left; one across a 32-bit bound gives up what lies beyond it, so no carry can come."""
    go = np.flatnonzero(rng < WORD)
    if len(go):
        a, b = low[go], rng[go]
        across = (a ^ (a + b)) >= WORD
        rng[go] = np.where(across, (~a + np.uint64(1)) & (WORD - np.uint64(1)), b)
    return go


class Encoder:
    """A range coder with 64-bit state for each lane, giving out words of 32 bits."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.words: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, at: np.ndarray | slice, first: np.ndarray, width: np.ndarray, total: np.ndarray | np.uint64) -> None:
        """Narrow the lanes' ranges to [first, first + width) of total."""
        unit = self.range[at] // total
        low, rng = self.low[at] + first * unit, unit * width
        go = narrowed(low, rng)
        if len(go):
            self.words.append(((go if isinstance(at, slice) else at[go]).astype(np.uint16), (low[go] >> HALF).astype(np.uint32)))
            low[go] <<= HALF
            rng[go] <<= HALF
        self.low[at], self.range[at] = low, rng

    def streams(self) -> list[bytes]:
        """Each lane's bytes, ended by as few as name a number in its range (missing ones are read as 0)."""
        lanes = np.concatenate([a for a, _ in self.words]) if self.words else np.zeros(0, np.uint16)
        words = np.concatenate([w for _, w in self.words]) if self.words else np.zeros(0, np.uint32)
        order = np.argsort(lanes, kind="stable")
        ends = np.cumsum(np.bincount(lanes, minlength=len(self.low))).tolist()
        tail, size = np.zeros(len(self.low), np.uint64), np.where(self.low == 0, 0, 8)
        for k in range(8, 0, -1):
            rest = np.uint64((1 << (64 - 8 * k)) - 1)
            v = (self.low + rest) & ~rest  # 0 beyond the last number
            fits = (v >= self.low) & (v - self.low < self.range) & (size > 0)
            tail[fits], size[fits] = v[fits], k
        tails, data, at, out = tail.astype(">u8").tobytes(), words[order].astype(">u4").tobytes(), 0, []
        for k, (end, n) in enumerate(zip(ends, size.tolist(), strict=True)):
            out.append(data[4 * at : 4 * end] + tails[8 * k : 8 * k + n])
            at = end
        return out


class Decoder:
    def __init__(self, streams: list[bytes]):
        longest = (max(map(len, streams), default=0) + 19) // 4 * 4
        self.words = np.frombuffer(b"".join(s.ljust(longest, b"\0") for s in streams), ">u4").astype(np.uint64)
        self.next = np.arange(len(streams)) * (longest // 4)
        self.end = self.next + longest // 4 - 1
        self.low, self.range = np.zeros(len(streams), np.uint64), np.full(len(streams), 2**64 - 1, np.uint64)
        self.code = self.words[self.next] << HALF | self.words[self.next + 1]
        self.next += 2

    def offset(self, at: np.ndarray | slice, total: np.uint64) -> np.ndarray:
        """How far into the lanes' ranges their codes lie; the unit is a total's part of the range."""
        self.unit = self.range[at] // total
        return self.code[at] - self.low[at]

    def target(self, at: np.ndarray | slice, total: np.uint64) -> np.ndarray:
        return np.minimum(self.offset(at, total) // self.unit, total - np.uint64(1))

    def take(self, at: np.ndarray | slice, first: np.ndarray, width: np.ndarray) -> None:
        low, rng = self.low[at] + first * self.unit, self.unit * width
        go = narrowed(low, rng)
        if len(go):
            lane = go if isinstance(at, slice) else at[go]
            low[go] <<= HALF
            rng[go] <<= HALF
            self.code[lane] = self.code[lane] << HALF | self.words[np.minimum(self.next[lane], self.end[lane])]
            self.next[lane] += 1
        self.low[at], self.range[at] = low, rng


def share(ends: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each lane's part begins and how wide it is."""
    n = ends.shape[1]
    at = part.astype(np.int64) * n + np.arange(n)
    first = ends.ravel().take(at, mode="clip")
    return first, ends.ravel().take(at + n, mode="clip") - first


def code_ids(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """The lanes' streams of a block's ids."""
    n = len(ids)
    lanes, steps = lanes_of(n)
    coder, model = Encoder(lanes, steps), Model(vocabulary)
    table = np.ascontiguousarray(np.pad(ids.astype(np.int64), (0, lanes * steps - n)).reshape(lanes, steps).T)
    before1 = before2 = np.full(lanes, vocabulary)
    for t in range(steps):
        live = min(lanes, max(0, -(-(n - t) // steps)))
        x = table[t, :live]
        ends = model.predict(before2[:live], before1[:live])
        miss = x != model.a
        left = miss & (x != model.p1)
        place = model.place.take(x, mode="clip")
        part = miss.view(np.int8) + left.view(np.int8) + (left & (place >= 0)).view(np.int8)
        coder.put(slice(0, live), *share(ends, part), SHARE)
        if len(at := np.flatnonzero(part == 3)):
            place = place[at]
            lo = model.cum.take(place)
            coder.put(at, lo, model.cum.take(place + 1) - lo, model.cum[-1])
        if len(at := np.flatnonzero(part == 2)):
            coder.put(at, x[at].astype(np.uint64), np.ones(len(at), np.uint64), np.uint64(vocabulary))
        model.learn(x, part, len(at))
        before2, before1 = before1[:live], x
    return coder.streams()


def uncode_ids(streams: list[bytes], n: int, vocabulary: int) -> np.ndarray:
    lanes, steps = lanes_of(n)
    coder, model = Decoder(streams), Model(vocabulary)
    table = np.zeros((steps, lanes), np.int32)
    before1 = before2 = np.full(lanes, vocabulary)
    for t in range(steps):
        live = min(lanes, max(0, -(-(n - t) // steps)))
        ends, at = model.predict(before2[:live], before1[:live]), slice(0, live)
        offset = coder.offset(at, SHARE)
        part = sum((offset >= ends[k] * coder.unit).view(np.int8) for k in (1, 2, 3))
        coder.take(at, *share(ends, part))
        x = np.where(part, model.p1, model.a).astype(np.int64)
        if len(at := np.flatnonzero(part == 3)):
            place = model.holder.take(coder.target(at, model.cum[-1]).astype(np.int64))
            lo = model.cum.take(place)
            coder.take(at, lo, model.cum.take(place + 1) - lo)
            x[at] = model.ids.take(place)
        if len(at := np.flatnonzero(part == 2)):
            v = coder.target(at, np.uint64(vocabulary))
            coder.take(at, v, np.ones(len(at), np.uint64))
            x[at] = v.astype(np.int64)
        table[t, :live] = x
        model.learn(x, part, len(at))
        before2, before1 = before1[:live], x
    return table.T.reshape(-1)[:n]


def write_block(docs: list[tuple[int | None, int, int]], ids: np.ndarray, start: int, vocabulary: int) -> bytes:
    """docs: (id, ids of it in this block, ids of it before this block). start: ids in the file before this block."""
    table = zlib.compress(b"".join(struct.pack("<?qIq", i is not None, i or 0, n, before) for i, n, before in docs), 1)
    streams = code_ids(ids, vocabulary) if len(ids) else []
    sizes = np.array([len(s) for s in streams], "<u4").tobytes()
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    made = b"".join([MAGIC, struct.pack("<IIIIIQ", vocabulary, len(docs), len(table), len(ids), crc, start), table, sizes, *streams])
    return made + struct.pack("<I", zlib.crc32(made))


def read_block(block: bytes) -> tuple[list[tuple[int | None, int, int]], np.ndarray, int]:
    """What write_block was given; ValueError if the block is damaged."""
    head = struct.calcsize("<IIIIIQ")
    if block[:4] != MAGIC or len(block) < 4 + head:
        raise ValueError("no block of ids")
    block, check = block[:-4], block[-4:]
    if struct.pack("<I", zlib.crc32(block)) != check:
        raise ValueError("damaged block")
    vocabulary, n_docs, table_size, n, crc, start = struct.unpack("<IIIIIQ", block[4 : 4 + head])
    at = 4 + head
    table = zlib.decompress(block[at : at + table_size])
    docs = [(i if known else None, k, before) for known, i, k, before in struct.iter_unpack("<?qIq", table)]
    at += table_size
    lanes = lanes_of(n)[0] if n else 0
    sizes = np.frombuffer(block[at : at + 4 * lanes], "<u4").tolist()
    at += 4 * lanes
    if len(docs) != n_docs or len(sizes) != lanes or at + sum(sizes) != len(block):
        raise ValueError("damaged block")
    streams = []
    for s in sizes:
        streams.append(block[at : at + s])
        at += s
    ids = uncode_ids(streams, n, vocabulary) if n else np.zeros(0, np.int32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged block")
    return docs, ids, start


def pieces_of(text: str) -> Iterator[str]:
    """A long text cut at blanks, at which the tokenizer's own words end too."""
    at = 0
    while len(text) - at > PIECE:
        m = re.compile(r"[ \t\n\r]").search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def gathered(flat: np.ndarray, end: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flat in the order of at, one after the other, and where each ends in the result. end, size: of each run in flat."""
    n = size[at]
    ends = np.cumsum(n)
    return flat[np.arange(len(ends) and ends[-1]) + np.repeat(end[at] - ends, n)], ends


class KeptIds(dict):
    """The place of each string met so far, and the ids of all of them in arrays. The first string is given, and has no ids."""

    def __init__(self, blank: str):
        super().__init__()
        self.blank = blank
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[self.blank] = 0
        self.new: list[str] = []
        self.chars, self.flat = 0, np.zeros(0, np.int32)
        self.end = self.size = np.zeros(1, np.int64)

    def __missing__(self, string: str) -> int:
        at = self[string] = len(self)
        self.new.append(string)
        self.chars += len(string)
        return at

    def full(self) -> bool:
        return len(self) > KEPT_WORDS or self.chars > KEPT_CHARS

    def places(self, strings: list[str], made) -> np.ndarray:
        """The place of each string. made: gives the ids of those not met so far, one after the other, and how many each has."""
        at = np.fromiter(map(self.__getitem__, strings), np.int64, len(strings))
        if self.new:
            flat, size = made(self.new)
            self.end = np.concatenate([self.end, len(self.flat) + np.cumsum(size)])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
            self.new = []
        return at

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings of these places, one after the other, and where those of each end."""
        return gathered(self.flat, self.end, self.size, at)


class WordIds:
    """The ids of texts by those of their distinct blank-separated words.

    The tokenizer drops blanks and lets no token cross one, so the ids of a text are those of its words. With a second
    tokenizer from cut_tokenizer(), plain words are cut where the first would cut them, and the library makes the ids of
    each distinct piece. What was given to the library is kept, and forgotten when it gets many or large; nothing depends on it.
    """

    def __init__(self, tokenizer, of_pieces=None):
        self.tokenizer, self.of_pieces = tokenizer, of_pieces
        ids = self.made(tokenizer, [BREAK])[0]
        self.break_id = int(ids[0]) if len(ids) == 1 else -1
        if of_pieces:
            self.last = np.zeros(of_pieces.get_vocab_size(), bool)
            self.last[[i for token, i in of_pieces.get_vocab().items() if token.endswith(END)]] = True
        self.words, self.pieces = KeptIds(""), KeptIds("\n")

    def __len__(self) -> int:
        return len(self.words)

    def forget(self) -> None:
        self.words.forget()
        self.pieces.forget()

    def made(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_apart(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        apart = self.made(tokenizer, words)
        return np.concatenate(apart), np.fromiter(map(len, apart), np.int64, len(apart))

    def ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By a text of many words, with one between them that has one id."""
        flat, sizes = [], []
        groups = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for some, ids in zip(groups, self.made(self.tokenizer, [f" {BREAK} ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.break_id)
            if len(cuts) == len(some) - 1:
                ids, size = np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1
            else:  # a word gives that id itself
                ids, size = self.ids_apart(self.tokenizer, some)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def ids_of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By a text of many pieces: the last id of each is one of those that end a piece."""
        flat, sizes = [], []
        groups = [pieces[at : at + TOGETHER] for at in range(0, len(pieces), TOGETHER)]
        for some, ids in zip(groups, self.made(self.of_pieces, [" ".join(g) for g in groups]), strict=True):
            size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            if len(size) != len(some) or size.sum() != len(ids):
                ids, size = self.ids_apart(self.of_pieces, some)
            flat.append(ids)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def ids_of_plain_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py()
        at = self.pieces.places(CUT.findall(text.lower() + "\n"), self.ids_of_pieces)
        flat, end = self.pieces.ids(at)
        return flat, np.diff(end[at == 0], prepend=0)

    def ids_of_other_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, end = self.words.ids(self.words.places(words.to_pylist(), self.ids_of_words))
        return flat, np.diff(end, prepend=0)

    def ids_of_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        if not self.of_pieces:
            return self.ids_of_other_words(words)
        odd = pc.match_substring_regex(words, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.ids_of_plain_words(words)
        order = np.argsort(odd, kind="stable")
        plain, other = np.split(order, [len(words) - np.count_nonzero(odd)])
        flat, size = self.ids_of_other_words(words.take(pa.array(other)))
        if len(plain):
            a, n = self.ids_of_plain_words(words.take(pa.array(plain)))
            flat, size = np.concatenate([a, flat]), np.concatenate([n, size])
        back = np.argsort(order)
        return gathered(flat, np.cumsum(size), size, back)[0], size[back]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        for kept in (self.words, self.pieces):
            if kept.full():
                kept.forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = split.flatten().dictionary_encode()
        flat, size = self.ids_of_distinct(words.dictionary)
        ids, end = gathered(flat, np.cumsum(size), size, words.indices.to_numpy())
        return np.split(ids, np.concatenate([[0], end])[split.offsets.to_numpy()[1:-1]])


def cut_tokenizer(tokenizer):
    """The same tokenizer for pieces that are in lower case and cut already, with a blank between them; None if it isn't of the kind that CUT is of."""
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer.to_str())
    model = spec["model"]
    if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or spec["post_processor"] or spec["truncation"] or spec["padding"]:
        return None
    if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["end_of_word_suffix"] != END or model["continuing_subword_prefix"]:
        return None
    if not all(a["content"].startswith("<|") for a in spec["added_tokens"]):
        return None
    spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": PRE_TOKENIZER | {"pretokenizers": [{"type": "WhitespaceSplit"}, *PRE_TOKENIZER["pretokenizers"][1:]]}}
    return Tokenizer.from_str(json.dumps(spec))


@lru_cache(1)
def word_ids(tokenizer_path: str) -> WordIds:
    """One for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    return WordIds(tokenizer, cut_tokenizer(tokenizer))


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, vocabulary: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize every whole text, end each by end_id, and write the blocks below path: files in ascending order of doc_id.

    Null and empty texts have the end id alone. Null ids come first; rows of one id follow in the order of a hash of
    their texts. A text longer than a block goes over several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = word_ids(tokenizer_path)
        size = vocabulary or max(words.tokenizer.get_vocab_size(), end_id + 1)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("block", pa.binary())])
        table: list[tuple] = []
        held: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal table, held, n, seq, start
            ids = np.concatenate(held) if held else np.zeros(0, np.int32)
            made = batch_of(schema, ([part], [seq], [write_block(table, ids, start, size)]))
            table, held, n, seq, start = [], [], 0, seq + 1, start + n
            return made

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b, texts in groups_of(batch, 1, BATCH_BYTES):
                if len(texts) == 1 and len(texts[0]) > PIECE:
                    coded = [np.concatenate([x for p in pieces_of(texts[0]) for x in words.encode([p])])]
                else:
                    coded = words.encode(texts)
                for name, ids in zip(names[a:b], coded, strict=True):
                    ids = np.append(ids, np.int32(end_id))
                    if n and n + len(ids) > BLOCK:
                        yield close()
                    before = 0
                    while len(ids) - before > BLOCK:
                        table, held, n = [(name, BLOCK, before)], [ids[before : before + BLOCK]], BLOCK
                        before += BLOCK
                        yield close()
                    table.append((name, len(ids) - before, before))
                    held.append(ids[before:])
                    n += len(ids) - before
        if table:
            yield close()

    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = keyed_text(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(run, "part int, seq int, block binary").write.option("compression", "none").parquet(path)


def crc_combine(a: int, b: int, n: int) -> int:
    """The CRC-32 of two strings together, from those of each and the second's length: a is moved on by n zero bytes."""
    if n == 0:
        return a
    odd = [0xEDB88320, *(1 << i for i in range(31))]  # the operator of one zero bit

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    m = odd
    for _ in range(3):
        m = [times(m, x) for x in m]  # of eight bits
    while n:
        if n & 1:
            a = times(m, a)
        n >>= 1
        if n:
            m = [times(m, x) for x in m]
    return a ^ b


def joined(pdf):
    """One document from its parts in several blocks."""
    import pandas as pd

    p = pdf.sort_values("before")
    crc, n = 0, 0
    for c, k in zip(p["crc"].tolist(), p["n"].tolist(), strict=True):
        crc, n = crc_combine(crc, c, 4 * k), n + k
    return pd.DataFrame({"part": [p["part"].iloc[0]], "doc_id": p["doc_id"].iloc[:1].astype("Int64").tolist(), "at": [p["at"].min()], "n": [n], "crc": [crc]})


def read_ids(spark, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from the blocks below path; a damaged block stops the job. With ids, a row for each part of a document in a block, with before (ids of it in earlier blocks) and its ids."""
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("before", pa.int64()), ("crc", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, got, start = read_block(block.as_buffer().to_pybytes())
                data, at, rows = got.astype("<u4"), 0, []
                for name, n, before in docs:
                    own = data[at : at + n]
                    rows.append((part, name, start + at, n, before, zlib.crc32(own.tobytes()), own.astype(np.int32) if ids else None))
                    at += n
                if rows:
                    yield batch_of(schema, zip(*rows, strict=True))

    blocks = spark.read.parquet(path)
    parts = blocks.select("part", "block").mapInArrow(run, "part int, doc_id long, at long, n long, before long, crc long, ids array<int>")
    if ids:
        return parts.select("doc_id", "before", "n", "ids")
    return parts


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the ids' files into the shared folder and read them back: doc_id, start, n_tokens, ids_crc32. An empty table gives none."""
    spark = docs.sparkSession
    ws = Workspace(spark, "ids")
    write_ids(docs, tokenizer_path, ws.path("ids"))
    parts = ws.save(read_ids(spark, ws.path("ids")).drop("ids"), "parts")
    first = parts.groupBy("part").agg(F.sum("n").alias("total"))
    first = first.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    # A document in several blocks: a full block of it alone, then further ones, each beginning where the last ended.
    several = (F.col("before") > 0) | (F.col("n") == BLOCK)
    long = parts.where(several).withColumn("origin", F.col("at") - F.col("before"))
    long = long.groupBy("part", "origin").applyInPandas(joined, "part int, doc_id long, at long, n long, crc long")
    whole = parts.where(~several).select("part", "doc_id", "at", "n", "crc").unionByName(long)
    return whole.join(F.broadcast(first), "part").select("doc_id", (F.col("at") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
