"""WARC archives: writing, and reading back by boundary-chain verification.

Spark's text writer makes the archives (a record, then CRLF CRLF), and its reader cuts them at every occurrence of
the magic line, wherever a task's byte range begins, so a file of any length is read by many tasks. Such an
occurrence is only a candidate: a payload may hold the magic line and even whole records. Each task emits for its
candidates the offset of their successor, from Content-Length. Only what can be reached from the start of the file
over successors is a record: first pointers are followed within each byte range, then pointer jumping over the ranges'
exits finds where the chain enters each range, and the records are those on the chain from there. Pieces between
two records' starts are the payload of the first.

What tasks exchange is offsets and digests. Bytes are kept only of pieces that are no whole record by themselves
or that a candidate of the same range covers; if a record turns out to need others (an archive within a payload
across two ranges), the archives are scanned once more, keeping all pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace, batch_of, row_count

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
M = len(MAGIC)
BROADCAST_IDS = 500_000
DATE = "1970-01-01T00:00:00Z"

FIELDS = "page_id long, record_type string, refers_to long, uri string, payload_bytes long, payload_digest string"
PIECES = f"file string, block long, seq long, at long, size long, candidate boolean, whole boolean, next_at long, raw binary, {FIELDS}, payload binary"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header_value(text: str | None) -> str:
    """One line without control characters, which a header can't hold."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def record_text(page_id: int | None, url: str | None, html: str | None, sha1: str, size: int, refers_to: int | None, revisit: bool) -> str:
    """A record without its end mark."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    body = "" if revisit else html or ""
    block = len(http.encode()) + (0 if revisit else size)
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(sha1))}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return MAGIC.decode() + "\r\n".join(lines) + "\r\n\r\n" + http + body


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each row, into files below path.

    Of rows with equal payloads that with the largest id holds it, the others are revisit records that refer to it. Null
    html is an empty payload; a null id is smaller than any other; rows that repeat both id and payload are
    all responses if their id is the largest. The revisits' ids are broadcast while they are few, else joined.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc-write")
    html = F.coalesce(pages[html_col], F.lit(""))
    named = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), html.cast("string").alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    narrow = ws.save(named.select("page_id", "url", "sha1", F.octet_length("html").cast("long").alias("size")), "narrow")
    shared = narrow.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").select("sha1", "refers_to")
    revisits = ws.save(narrow.join(shared, "sha1").where("page_id is null or page_id < refers_to"), "revisits")
    again = revisits.select(F.col("page_id").alias("r_id"), F.col("sha1").alias("r_sha1")).distinct()
    if row_count(again) <= BROADCAST_IDS:
        again = F.broadcast(again)
    responses = named.join(again, (named["sha1"] == again["r_sha1"]) & named["page_id"].eqNullSafe(again["r_id"]), "left_anti")
    schema = pa.schema([("value", pa.string())])

    def records(revisit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, held = [], 0
                for r in zip(*batch.columns, strict=True):
                    out.append(record_text(*(x.as_py() for x in r), revisit))
                    held += len(out[-1])
                    if held > 4_000_000:
                        yield batch_of(schema, (out,))
                        out, held = [], 0
                yield batch_of(schema, (out,))

        return run

    none = F.lit(None)
    first = responses.select("page_id", "url", "html", "sha1", F.octet_length("html").cast("long").alias("size"), none.cast("long").alias("refers_to")).mapInArrow(records(False), "value string")
    rest = revisits.select("page_id", "url", none.cast("string").alias("html"), "sha1", "size", "refers_to").mapInArrow(records(True), "value string")
    first.unionByName(rest).write.option("lineSep", END.decode()).text(path)
    ws.drop("narrow", "revisits")


def number(value: bytes | None) -> int | None:
    m = re.search(rb"(-?\d+)>?\s*$", value or b"")
    return int(m[1]) if m else None


def headers(block: bytes) -> dict[bytes, bytes]:
    """Names in lower case; lines without a colon are left out."""
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parse(data: bytes) -> tuple[int | None, bool, tuple | None, bytes | None]:
    """(length from the magic line to the next record, or None if this is no header; is the piece just that record; its fields; its payload)."""
    head = data.find(END)
    if head < 0:
        return None, False, None, None
    h = headers(data[:head])
    length = h.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in h or len(length) > 15:
        return None, False, None, None
    body, size = head + 4, int(length)
    step = M + body + size + 4
    if len(data) < body + size:
        return step, False, None, None
    block = data[body : body + size]
    kind, uri = h[b"warc-type"].decode(errors="replace"), h.get(b"warc-target-uri")
    payload, told = block, None
    if block.startswith(b"HTTP/"):
        top, mark, payload = block.partition(END)
        told = headers(top).get(b"content-length") if mark else None
        payload = payload if mark else block
    digest = base32_sha1(hashlib.sha1(payload).digest())
    count = len(payload)
    refers = None
    if kind == "revisit":
        digest = h.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode(errors="replace") or digest
        count = int(told) if told and told.isdigit() else count
        refers = number(h.get(b"warc-refers-to"))
    fields = (number(h.get(b"warc-record-id")), kind, refers, uri.decode(errors="replace") if uri is not None else None, count, digest)
    return step, len(data) == body + size + 4 and data.endswith(END), fields, payload


def scan(spark: SparkSession, path: str, keep_all: bool, payloads: bool) -> DataFrame:
    """PIECES: what lies between two magic lines, with offsets within the task's byte range (next_at too)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("candidate", pa.bool_()), ("whole", pa.bool_()), ("next_at", pa.int64()), ("raw", pa.binary()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, seq, at, covered = None, 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for f, b, v in zip(*batch.columns, strict=True):
                file, block, data = f.as_py(), b.as_py(), v.as_py()
                if (file, block) != where:
                    where, seq, at, covered = (file, block), 0, 0, 0
                candidate = block > 0 or seq > 0  # what stands before a file's first magic line is none
                step, whole, fields, payload = parse(data) if candidate else (None, False, None, None)
                start = at - M
                next_at = start + step if step is not None else None
                keep = keep_all or not whole or start < covered
                if next_at is not None and not whole:
                    covered = max(covered, next_at)
                out.append((file, block, seq, start, len(data), candidate, whole, next_at, data if keep else None, *(fields or (None,) * 6), payload if payloads and whole else None))
                held += len(data) * (keep + payloads)
                seq, at = seq + 1, at + len(data) + M
                if held > 8_000_000 or len(out) >= 20_000:
                    yield batch_of(schema, zip(*out, strict=True))
                    out, held = [], 0
            if out:
                yield batch_of(schema, zip(*out, strict=True))

    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")).mapInArrow(run, PIECES)


def exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of one byte range the offset at which its chain leaves the range, by pointer jumping."""
    c = pdf[pdf["next_at"].notna()].sort_values("at")
    at, to = c["at"].to_numpy(), c["next_at"].to_numpy().astype("int64")
    i = np.searchsorted(at, to)
    inside = (i < len(at)) & (at[np.minimum(i, len(at) - 1)] == to) if len(at) else np.zeros(0, bool)
    jump = np.where(inside, i, np.arange(len(at)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return pd.DataFrame({"file": c["file"], "block": c["block"], "at": at, "exit_at": to[jump]})


def on_chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of one byte range: candidates on the chain from its entries; owner: of each piece, the record it is part of."""
    p = pdf.sort_values("at")
    at = p["at"].to_numpy()
    nxt = p["next_at"].to_numpy()
    on = np.zeros(len(at), bool)
    for e in np.flatnonzero(p["entry"].to_numpy()):
        i = int(e)
        while not on[i]:
            on[i] = True
            if np.isnan(nxt[i]):
                break
            j = int(np.searchsorted(at, nxt[i]))
            if j >= len(at) or at[j] != nxt[i]:
                break
            i = j
    owner = pd.Series(np.where(on, at, np.nan)).ffill()
    return pd.DataFrame({"file": p["file"].to_numpy(), "block": p["block"].to_numpy(), "seq": p["seq"].to_numpy(), "at": at, "record": on, "owner": owner.astype("Int64")})


def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
    """One record from its pieces."""
    p = pdf.sort_values("at")
    data = MAGIC.join(bytes(x) for x in p["raw"])
    step, _, fields, payload = parse(data)
    names = [x.split()[0] for x in FIELDS.split(", ")]
    row = dict(zip(names, fields or (None,) * 6, strict=True)) | {"file": p["file"].iloc[0], "at": p["owner"].iloc[0], "complete": fields is not None, "payload": payload}
    out = pd.DataFrame([row])
    for k in ("page_id", "refers_to", "payload_bytes"):
        out[k] = out[k].astype("Int64")
    return out[[*names, "file", "at", "complete", "payload"]]


def read_archives(spark: SparkSession, path: str, payloads: bool = False, keep_all: bool = False) -> DataFrame:
    """The records of all archives below path: page_id, record_type, refers_to, uri, payload_bytes, payload_digest, file, at (offset), payload.

    A revisit record gives the size and digest of the payload it stands for. payload is null unless payloads is set.
    A file that doesn't begin with the magic line, or an empty one, gives no records; where a chain breaks (a damaged
    length, a file cut off) the records up to there are given, the incomplete one not.
    """
    ws = Workspace(spark, "warc-read")
    pieces = ws.save(scan(spark, path, keep_all or payloads, payloads), "pieces")
    key = ["file", "block"]
    span = pieces.groupBy(*key).agg(F.sum(F.col("size") + M).alias("span"))
    base = ws.save(span.select(*key, F.coalesce(F.sum("span").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "base")
    narrow = pieces.drop("raw", "payload").join(base, key).withColumns({"at": F.col("at") + F.col("base"), "next_at": F.col("next_at") + F.col("base")}).drop("base")
    narrow = ws.save(narrow, "narrow")

    chain = narrow.where("candidate").select(*key, "at", "next_at")
    jump = ws.save(chain.groupBy(*key).applyInPandas(exits, "file string, block long, at long, exit_at long"), "jump")
    entries = ws.save(jump.where("at = 0").select("file", "at"), "entries")
    hops = jump.select("file", "at", "exit_at")
    known = row_count(entries)
    while known:
        landed = entries.join(hops, ["file", "at"]).select("file", F.col("exit_at").alias("at")).join(jump.select("file", "at"), ["file", "at"], "left_semi")
        entries = ws.save(entries.unionByName(landed).distinct(), "entries")
        if (n := row_count(entries)) == known:
            break
        known = n
        second = hops.select("file", F.col("at").alias("exit_at"), F.col("exit_at").alias("then"))
        hops = ws.save(hops.join(second, ["file", "exit_at"]).select("file", "at", F.col("then").alias("exit_at")), "hops")

    entered = narrow.select(*key, "seq", "at", "next_at").join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    owned = entered.groupBy(*key).applyInPandas(on_chain, "file string, block long, seq long, at long, record boolean, owner long")
    owned = ws.save(owned, "owned")
    records = narrow.join(owned.where("record").select(*key, "seq"), [*key, "seq"], "left_semi")
    names = [x.split()[0] for x in FIELDS.split(", ")]
    whole = records.where("whole").select(*key, "seq", *names, "at")
    if payloads:
        whole = whole.join(pieces.select(*key, "seq", "payload"), [*key, "seq"])
    else:
        whole = whole.withColumn("payload", F.lit(None).cast("binary"))
    whole = whole.select(*names, "file", "at", "payload")
    broken = records.where("not whole and next_at is not null")
    if not row_count(broken):
        return whole

    # A range's first pieces belong to the last record of an earlier range.
    last = owned.groupBy(*key).agg(F.max(F.when(F.col("record"), F.col("at"))).alias("last"))
    carry = last.select(*key, F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    parts = owned.join(carry, key).select(*key, "seq", F.col("at").alias("piece_at"), F.coalesce("owner", "carry").alias("owner"))
    of = broken.select("file", F.col("at").alias("owner"), "next_at")
    parts = parts.join(of, ["file", "owner"]).where("piece_at < next_at").join(pieces.select(*key, "seq", "raw"), [*key, "seq"]).select("file", "owner", F.col("piece_at").alias("at"), "raw")
    if not keep_all and not payloads and not parts.where("raw is null").isEmpty():
        return read_archives(spark, path, payloads, keep_all=True)
    made = parts.groupBy("file", "owner").applyInPandas(assemble, f"{FIELDS}, file string, at long, complete boolean, payload binary").where("complete").drop("complete")
    if not payloads:
        made = made.withColumn("payload", F.lit(None).cast("binary"))
    return whole.unionByName(made)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages' archives into the shared folder and read them back."""
    ws = Workspace(pages.sparkSession, "archives")
    write_archives(pages, ws.path("warc"))
    return read_archives(pages.sparkSession, ws.path("warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")
