"""Secret scans: base patterns, and strings that a dictionary-primed zstandard coder finds new.

A candidate is a run of key-like characters close behind a sensitive word; of NAME=value it is the value. Its novelty
is its marginal compressed size: the bytes that the text before it takes with the candidate, less the bytes it takes
without, coded by zstandard with a dictionary of identifiers and of the code around. A name, a path or a repeated value costs next to nothing
there; a key costs most of its entropy. Every candidate is measured. What costs at least NOVEL of its length in bytes is
reported, but runs that any long word may look like (letters of one case, or digits only) have to cost PLAIN of it.
From LONG characters on, where zstandard codes letters by frequency, the bytes that their frequencies ask for do, if
they are LEAST_BYTES. A long word that neither the dictionary nor the text around knows is as new as a key.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import batch_of, bound_batches, groups_of, keyed_text

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# A word ends where letters end or case turns as in accessKey and DBPassword.
TURN = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
SENSITIVE = re.compile(rf"(?:(?<![A-Za-z])|{TURN})(?i:(?:passphrase|password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|signing[_-]?key|credential|bearer|authorization|auth[_-]?key|cookie[_-]?key)s?)(?:(?![A-Za-z])|{TURN})", re.ASCII)
SENSITIVE_WORDS = (*ASSIGN_WORDS, b"passphrase", b"pwd", b"key", b"credential", b"bearer", b"authorization")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_~=-]{16,}", re.ASCII)
NAME = re.compile(r"[A-Za-z0-9_-]*=+", re.ASCII)
LEAST_KEY = 16
REACH, AROUND = 48, 2_000
NOVEL, PLAIN, LEAST_LETTERS, LEAST_DIGITS = 0.6, 0.88, 3, 3
LONG, LEAST_BYTES = 64, 12
CANDIDATE_CHAR = re.compile(r"[A-Za-z0-9+/_~=-]", re.ASCII)
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret client_id credentials bearer authorization username user_id session_id "
    "get_value set_value create_user update_record delete_item request response configuration environment parameter connection database hostname localhost "
    "example.com https:// http:// /usr/local/bin /home/user/ import return function class public static private protected string integer boolean "
    "self.config os.environ process.env System.getenv application/json Content-Type multipart/form-data abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
)

OUTPUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str, lower: bytes) -> list[Span]:
    """Leftmost matches without overlaps of each kind; start and end of the whole match in code points."""
    out = []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"akia" in lower:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def starts(text: str, a: int, b: int) -> list[int]:
    """Where a key in the run a:b may begin: at its start, unless that is the tail of the sensitive word's own name, else behind "name="."""
    out = [] if a and CANDIDATE_CHAR.match(text, a - 1) else [a]
    named = NAME.match(text, a, b)
    return [*out, named.end()] if named and b - named.end() >= LEAST_KEY else out


def least_cost(s: str) -> float:
    """The new bytes from which a candidate is a key."""
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    cased = not s.islower() and not s.isupper()
    mixed = letters >= LEAST_LETTERS and (digits >= LEAST_DIGITS or cased)
    least = (NOVEL if mixed else PLAIN) * len(s)
    if len(s) < LONG:
        return least
    return min(least, max(LEAST_BYTES, sum(n * math.log2(len(s) / n) for n in Counter(s).values()) / 8))


class Novelty:
    """Marginal compressed bytes of a string, given the text around it."""

    def __init__(self) -> None:
        import zstandard

        self.z = zstandard
        self.base = IDENTIFIERS.encode()

    def marginal(self, text: str, start: int, end: int) -> int:
        own = text[start:end]  # a key that stands there twice is no less a key
        before, after = (x.replace(own, " ") for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        primed = self.z.ZstdCompressionDict(self.base + after.encode() + b"\n" + before.encode(), dict_type=self.z.DICT_TYPE_RAWCONTENT)
        coder = self.z.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
        context = before[-64:].encode()
        return len(coder.compress(context + own.encode())) - len(coder.compress(context))

    def novel(self, text: str, start: int, end: int) -> bool:
        return self.marginal(text, start, end) >= least_cost(text[start:end])

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Novel candidates that overlap nothing taken (sorted by start)."""
        first, reach = [p for p, _, _ in taken], list(accumulate((q for _, _, q in taken), max))
        out, last = [], 0
        for word in SENSITIVE.finditer(text):
            at, until = max(last, word.end()), word.end() + REACH + LEAST_KEY
            while m := CANDIDATE.search(text, at, until):
                a, b = CANDIDATE.match(text, m.start()).span()  # its end may lie further on
                at = last = b
                before = bisect_left(first, b)
                for x in starts(text, a, b):
                    if not (before and reach[before - 1] > x) and self.novel(text, x, b):
                        out.append((x, 3, b))
                        break
        return out


def find_spans(text: str, novelty: Novelty) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and kind."""
    lower = text.encode().lower()
    base = base_spans(text, lower)
    if any(w in lower for w in SENSITIVE_WORDS):
        return base, sorted(base + novelty.spans(text, base))
    return base, base


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) of every whole text.

    Offsets are code points, ends exclusive, of the whole match. Letters in sensitive words match in either case, in
    ASCII only. Null and empty texts have no spans; null ids and repeated rows stay; an empty table gives none.
    One narrow stage without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in groups_of(batch, 1):
                out = []
                for i, t in zip(ids[a:b], texts, strict=True):
                    base, spans = find_spans(t, novelty)
                    kinds = [k for _, k, _ in base]
                    out.append((i, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
                yield batch_of(OUTPUT, zip(*out, strict=True))

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by the mark, overlapping spans by one; other columns and clean texts stay, null too.

    Whole texts are scanned, however long: a batch ends at some bytes, so a very long text is alone in it. Repeated rows stay
    repeated, an empty table gives none.
    """

    bound_batches(docs.sparkSession)

    def redacted(text: str, novelty: Novelty) -> str:
        _, spans = find_spans(text, novelty)
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]]) if spans else text

    @F.pandas_udf("string")
    def replaced(texts):
        novelty = Novelty()
        return texts.map(lambda t: None if t is None else redacted(t, novelty))

    return docs.withColumn(text_col, replaced(docs[text_col]))
