"""Benchmark decontamination: CGK random-walk embeddings, bit-sampling LSH, exact edit verification.

The CGK embedding walks over a word sequence: at step j it notes the word it stands on and goes on to the next word
if a random bit of (j, word) says so, else it stays. Two sequences that a few edits part walk in step again and again,
so their embeddings agree in many places: edit distance has become Hamming distance, and a few sampled places of the
embedding are a locality-sensitive key. Each walk gives several keys; as many walks are taken as bring copies of
the items with the largest allowed number of edits to the target recall, measured by simulation on the items.

Every word position of every text starts a window for each item length. Bounds that lose nothing come before the walk:
with at most k word edits, all but k of an item's n words, all but 2k of its n - 1 word pairs and all but 3k of its
n - 2 triples stand in the window, so those that the benchmark knows are counted from prefix sums. Candidates end in an exact semi-global
word edit distance.

Items of fewer than MIN_WORDS words allow one edit at most, so one half of such an item is whole in every copy of it:
they are found by the hashes of their halves (or of the whole item where it allows none), without loss. For a length
for which MOST_WALKS walks don't reach the recall, all windows that the counts leave are verified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace, batch_of, groups_of, keyed_text, text_hash, without

MAX_EDIT = 0.25
RECALL = 0.995
MIN_WORDS = 8
TRIALS = 400
ITEM_BYTES = 8 << 20
KEYS, PLACES, MOST_WALKS = 6, 2, 48
RUN_BITS = 22
PAD, GAP = -2, -3
SEED = 11
KEPT_WORDS = 200_000

OUTPUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("start_word", pa.int64()), ("text_hash", pa.int64())])
SCHEMA = "doc_id long, item_id long, edits int, item_words int, start_word long, text_hash long"


#: Characters of scripts that are written without blanks: each is a word.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def tokens_of(text: str) -> list[str]:
    return (text if text.isascii() else SPACELESS.sub(r" \g<0> ", text)).split()


def bare(token: str) -> str:
    """Letters and digits of a token in lower case."""
    return token.lower() if token.isalnum() else "".join(c for c in token.lower() if c.isalnum())


class Words(dict):
    """The number of each blank-separated token: that of its word in the vocabulary, 0 for any other word, -1 for none."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        word = bare(token)
        n = self.vocabulary.get(word, 0) if word else -1
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[token] = n
        return n


def coin(symbols: np.ndarray, step: int, walks: np.ndarray) -> np.ndarray:
    """The random bit of each walk (row) for each symbol at a step."""
    with np.errstate(over="ignore"):
        x = (symbols.astype(np.uint64) + (step * 1_000_003 + walks * 7_368_787 + 12_345).astype(np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(np.int64)


def places(n: int, walk: int) -> np.ndarray:
    """KEYS x PLACES sampled places of a walk over n words: within two steps a word, where a walk is still inside."""
    rng = np.random.default_rng([SEED, n, walk])
    return np.sort(rng.integers(0, max(2, int(1.8 * n)), (KEYS, PLACES)), axis=1)


def embedded(words: np.ndarray, starts: np.ndarray, n: int, walks: np.ndarray) -> np.ndarray:
    """Keys of the windows of n words at the starts: walks x KEYS x starts; -1 where a place shows an unknown word."""
    at = np.stack([places(n, int(w)) for w in walks])
    wanted: dict[int, list[int]] = {}
    for w, rows in enumerate(at.reshape(len(walks), -1).tolist()):
        for step in set(rows):
            wanted.setdefault(step, []).append(w)
    i = np.zeros((len(walks), len(starts)), np.int64)
    seen: dict[tuple[int, int], np.ndarray] = {}
    for step in range(max(wanted) + 1):
        symbol = np.where(i < n, words[np.minimum(starts + i, len(words) - 1)], PAD)
        for w in wanted.get(step, ()):
            seen[w, step] = symbol[w]
        i += coin(symbol, step, walks)
    out = np.zeros((len(walks), KEYS, len(starts)), np.int64)
    for w, k in np.ndindex(len(walks), KEYS):
        unknown = np.zeros(len(starts), bool)
        for p in at[w, k].tolist():
            out[w, k] = out[w, k] * 2_000_003 + seen[w, p] - GAP
            unknown |= (seen[w, p] == 0) | (seen[w, p] == GAP)
        out[w, k, unknown] = -1
    return out


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least word edits between the item and any part of the text, start of that part)."""
    m = len(text)
    steps = np.arange(m + 1)
    row, start = np.zeros(m + 1, np.int64), steps.copy()
    for k, w in enumerate(item, 1):
        new, origin = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], origin[0] = k, 0
        through = row[:-1] + (text != w)
        down = row[1:] + 1
        take = through <= down
        new[1:], origin[1:] = np.where(take, through, down), np.where(take, start[:-1], start[1:])
        best = np.minimum.accumulate(new - steps)
        first = np.maximum.accumulate(np.where(new - steps == best, steps, 0))  # the latest cell that attains the minimum
        row, start = best + steps, origin[first]
    end = int(row.argmin())
    return int(row[end]), int(start[end])


def run_keys(words: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of each run of m words."""
    out = np.full(max(0, len(words) - m + 1), m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(m):
            out = (out ^ words[k : len(out) + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Short:
    """Finds items that allow one edit at most."""

    def __init__(self, items: dict[int, np.ndarray], edits):
        self.items, self.edits = items, edits
        parts: dict[int, list[tuple[int, int, int]]] = {}  # by length of a part: its key, its item, its place in it
        for k, ws in items.items():
            half = len(ws) // 2
            for at, part in ((0, ws),) if not edits(len(ws)) else ((0, ws[:half]), (half, ws[half:])):
                parts.setdefault(len(part), []).append((int(run_keys(part, len(part))[0]), k, at))
        self.parts = {m: (np.array([x[0] for x in sorted(v)], np.uint64), sorted(v)) for m, v in parts.items()}

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places in words where it would start) by parts that are there."""
        for m, (keys, parts) in self.parts.items():
            text = run_keys(words, m)
            lo, hi = np.searchsorted(keys, text), np.searchsorted(keys, text, side="right")
            at = np.flatnonzero(hi > lo)
            found: dict[int, list[np.ndarray]] = {}
            for key in np.unique(lo[at]).tolist():
                here = at[lo[at] == key]
                for _, k, place in parts[key : int(hi[here[0]])]:
                    found.setdefault(k, []).append(here - place)
            for k, starts in found.items():
                yield k, np.unique(np.concatenate(starts))

    def near(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Those of the candidates around which all words but one of the item stand where they should, give or take one place."""
        for k, starts in self.candidates(words):
            ws, there = self.items[k], np.zeros(len(starts), np.int64)
            for j, w in enumerate(ws.tolist()):
                at = [np.clip(starts + j + d, 0, len(words) - 1) for d in ((-1, 0, 1) if self.edits(len(ws)) else (0,))]
                there += np.logical_or.reduce([words[x] == w for x in at])
            yield k, starts[there >= len(ws) - self.edits(len(ws))]


class Sieve:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float = MAX_EDIT, recall: float = RECALL, walks: dict[int, int] | None = None):
        split = [(i, [w for t in tokens_of(text or "") if (w := bare(t))]) for i, text in items]
        split = [(i, w) for i, w in split if w]
        df = Counter(w for _, ws in split for w in set(ws))
        self.max_edit = max_edit
        self.vocabulary = {w: k for k, w in enumerate(sorted(df), 1)}
        self.words = Words(self.vocabulary)
        self.items = [(i, np.array([self.vocabulary[w] for w in ws])) for i, ws in split]
        few = {k for k, (_, ws) in enumerate(self.items) if len(ws) < MIN_WORDS and self.edits(len(ws)) <= 1}
        self.short = Short({k: self.items[k][1] for k in sorted(few)}, self.edits)
        self.by_length: dict[int, list[int]] = {}
        for k, (_, ws) in enumerate(self.items):
            if k not in few:
                self.by_length.setdefault(len(ws), []).append(k)
        self.runs = [np.zeros(1 << RUN_BITS, bool) for _ in (2, 3)]  # by hash: a clash only lets a window through
        # Which lengths (by a bit each, lengths 64 apart sharing one) have a triple in an item of theirs.
        self.of_length = np.zeros(1 << RUN_BITS, np.uint64)
        for n, ks in self.by_length.items():
            for k in ks:
                for m, marks in enumerate(self.runs, 2):
                    marks[self.slots(self.items[k][1], m)] = True
                self.of_length[self.slots(self.items[k][1], 3)] |= np.uint64(1 << n % 64)
        longest = max((len(ws) for _, ws in self.items), default=0)
        self.gap = longest + 2 * self.edits(longest) + 1
        # For each length: how many known words, pairs and triples each window must have.
        self.least = {n: tuple(n - m + 1 - m * self.edits(n) for m in (1, 2, 3)) for n in self.by_length}
        self.walks = walks if walks is not None else {n: self.walks_for(n, recall) for n in self.by_length}
        self.keys = {n: self.item_keys(n) for n in self.by_length if self.walks[n]}

    @staticmethod
    def slots(words: np.ndarray, m: int) -> np.ndarray:
        """A hash of each run of m words."""
        h = words[: max(0, len(words) - m + 1)].copy()
        for k in range(1, m):
            h = (h * 2_654_435_761 + words[k : len(words) - m + 1 + k] * 40_503) % 4_294_967_291
        return h % (1 << RUN_BITS)

    def edits(self, n: int) -> int:
        return int(self.max_edit * n)

    def item_keys(self, n: int) -> np.ndarray:
        ks = self.by_length[n]
        return embedded(np.concatenate([self.items[k][1] for k in ks]), np.arange(len(ks)) * n, n, np.arange(self.walks[n]))

    def walks_for(self, n: int, recall: float) -> int:
        """How many walks find this share of copies of items of n words with as many edits as allowed (substitutions, insertions and deletions alike); 0 if MOST_WALKS do not."""
        rng = np.random.default_rng([SEED, n])
        left = []
        for _ in range(TRIALS):
            ws = self.items[self.by_length[n][rng.integers(len(self.by_length[n]))]][1]
            copy = ws.tolist()
            for _ in range(self.edits(n)):
                at, kind = int(rng.integers(len(copy))), int(rng.integers(3))
                copy[at : at + (kind != 1)] = [0] if kind < 2 else []
            left.append((ws, np.array([*copy, *[0] * n])[: 2 * n]))
        for walk in range(MOST_WALKS):
            at = np.arange(len(left))
            own = embedded(np.concatenate([a for a, _ in left]), at * n, n, np.array([walk]))[0]
            its = embedded(np.concatenate([np.resize(b, 2 * n) for _, b in left]), at * 2 * n, n, np.array([walk]))[0]
            left = [t for t, same in zip(left, ((own == its) & (own >= 0)).any(axis=0), strict=True) if not same]
            if len(left) <= (1 - recall) * TRIALS:
                return walk + 1
        return 0

    def windows(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each item length the starts of windows that the counts leave."""
        flags = [words > 0]
        for m, marks in enumerate(self.runs, 2):
            flags.append(np.zeros(len(words), bool))
            flags[-1][: max(0, len(words) - m + 1)] = marks[self.slots(words, m)]
            flags[-1] &= flags[0]
        lengths = np.zeros(len(words), np.uint64)
        lengths[: max(0, len(words) - 2)] = self.of_length[self.slots(words, 3)]
        sums = [np.concatenate([[0], np.cumsum(f, dtype=np.int32)]) for f in flags]

        def enough(starts: np.ndarray, width: int, least: tuple) -> np.ndarray:
            for s, x in zip(reversed(sums), reversed(least), strict=True):
                if x > 0 and len(starts):
                    starts = starts[s[np.minimum(starts + width, len(words))] - s[starts] >= x]
            return starts

        if not self.least:
            return
        # First with what any window must hold at least; nearly all positions go here.
        some = enough(np.flatnonzero(words != GAP), self.gap, tuple(min(x[i] for x in self.least.values()) for i in range(3)))
        for n, least in self.least.items():
            ok = enough(some, n + self.edits(n), least)
            if len(ok) and least[2] > 0:
                own = np.concatenate([[0], np.cumsum((lengths >> np.uint64(n % 64)) & np.uint64(1), dtype=np.int32)])
                ok = ok[own[np.minimum(ok + n + self.edits(n), len(words))] - own[ok] >= least[2]]
            if len(ok):
                yield n, ok

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(index of the text, item id, edits, words of the item, first word) of every item within the allowed edits, once for each text and item, with the least edits."""
        if not self.items:
            return []
        get, parts, first, at = self.words.__getitem__, [], [], 0
        for t in texts:
            ids = np.fromiter(map(get, tokens_of(t)), np.int64)
            ids = ids[ids >= 0]
            first.append(at)
            parts += [ids, np.full(self.gap, GAP)]  # no window reaches from one text into another
            at += len(ids) + self.gap
        words, begin, doc_end = np.concatenate(parts), np.array(first), [a + len(x) for a, x in zip(first, parts[::2], strict=True)]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, starts in self.windows(words):
            ks, pairs = self.by_length[n], {}
            if not self.walks[n]:
                pairs = {(int(x) // (self.edits(n) + 1), k): int(x) for x in starts for k in ks}
            else:
                mine, keys = self.keys[n], embedded(words, starts, n, np.arange(self.walks[n]))
            for w, c in np.ndindex(self.walks[n], KEYS):
                order = np.argsort(mine[w, c], kind="stable")
                sorted_keys, key = mine[w, c][order], keys[w, c]
                lo, hi = np.searchsorted(sorted_keys, key), np.searchsorted(sorted_keys, key, side="right")
                for x in np.flatnonzero((hi > lo) & (key >= 0)):
                    pairs |= {(int(starts[x]) // (self.edits(n) + 1), ks[j]): int(starts[x]) for j in order[lo[x] : hi[x]]}
            k = self.edits(n)
            for (_, item), p in sorted(pairs.items()):
                doc = int(np.searchsorted(begin, p, side="right")) - 1
                if best.get((doc, item), (1, 0))[0] == 0:
                    continue
                lo = max(int(begin[doc]), p - k)
                near, ws = words[lo : min(p + n + 2 * k, doc_end[doc])], self.items[item][1]
                if any(np.isin(self.slots(near, m), self.slots(ws, m)).sum() < self.least[n][m - 1] for m in (1, 2, 3)):
                    continue
                d, s = distance(ws, near)
                if d <= k:
                    key = doc, item
                    best[key] = min(best.get(key, (d + 1, 0)), (d, lo + s - int(begin[doc])))
        for item, starts in self.short.near(words):
            ws, k = self.items[item][1], self.edits(len(self.items[item][1]))
            for p in starts.tolist():
                doc = int(np.searchsorted(begin, max(p, 0), side="right")) - 1
                if best.get((doc, item), (1, 0))[0] > 0:
                    lo = max(int(begin[doc]), p - k)
                    d, s = distance(ws, words[lo : min(p + len(ws) + k, doc_end[doc])])
                    if d <= k:
                        best[doc, item] = min(best.get((doc, item), (d + 1, 0)), (d, lo + s - int(begin[doc])))
        return [(doc, self.items[item][0], d, len(self.items[item][1]), s) for (doc, item), (d, s) in sorted(best.items())]


def hits(docs: DataFrame, benchmark: DataFrame, max_edit: float, recall: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The rows of find_benchmark() with the hash of the row's text. Of several blocks of items the driver holds one at a time, and the rows found are a table in the shared folder."""
    spark = docs.sparkSession
    texts = keyed_text(docs, id_col, text_col).select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).head()[0]
    blocks, ws, out = max(1, -(-size // ITEM_BYTES)), Workspace(spark, "decontaminate"), []
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [tuple(r) for r in part.collect()]
        sent = spark.sparkContext.broadcast((rows, Sieve(rows, max_edit, recall).walks))
        found = texts.mapInArrow(searcher(sent, max_edit), SCHEMA)
        if blocks > 1:
            found = ws.save(found, f"hits{b}")
            sent.destroy()
        out.append(found)
    return reduce(DataFrame.unionByName, out)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, item_words, start_word: a row for each text and benchmark item that a part of the text equals up to max_edit of the item's words.

    Words are blank-separated, in lower case, by their letters and digits; each character of a script without blanks
    (Chinese, Japanese, Thai and the like) is a word. Items of up to three words allow no edit. Null and empty
    items match nothing, nor do null and empty texts; items with equal texts match each; repeated rows of docs give
    repeated rows. Whole texts are read, in one narrow stage for each block of some ITEM_BYTES of items (hashed into
    blocks of about that size): a block is what the driver holds and the executors get, so its size is bounded
    however many items there are.
    """
    return hits(docs, benchmark, max_edit, recall, id_col, text_col, item_col, item_text_col).drop("text_hash")


def searcher(sent: Broadcast, max_edit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, walks = sent.value
        sieve = Sieve(items, max_edit, walks=walks)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, texts in groups_of(batch, 1, 1_000_000):
                if found := sieve.find(texts):
                    yield batch_of(OUTPUT, zip(*((ids[a + d], *rest, hashes[a + d]) for d, *rest in found), strict=True))

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows in whose text an item was found; rows are judged one by one, whatever others have their id."""
    return without(docs, hits(docs, benchmark, max_edit, recall, id_col, text_col, item_col, item_text_col), id_col, text_col)
