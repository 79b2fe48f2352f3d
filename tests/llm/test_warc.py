"""WARC round trips against hashlib, with archives inside payloads and byte ranges of any length."""

import base64
import hashlib

import pytest

from shelfwatch.llm import warc
from shelfwatch.llm.queries import QUERIES

SCHEMA = "payload string, page_id long, url string, html string"
INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
HTML = ["", None, "plain", "ü\r\n\r\nx", "WARC/1.1\r\n", INNER, INNER * 3 + "tail", "x" + INNER, "WWARC/1.1\r\nWARC/1.1\r\n\r\n", "a" * 200_000, "plain", "plain", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\nshort"]


def expected(rows):
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        last = top.get(h or "")
        again = last is not None and (i is None or i < last)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([("clash", *r) for r in rows], SCHEMA)


ROWS = [(i, None if i == 3 else f"http://h/{i}\r\nX: y", h) for i, h in enumerate(HTML)] + [(None, "u", "plain"), (None, "u", "only null ids"), (2, "u", "plain"), (11, "u", "plain")]


@pytest.mark.parametrize("limit", ["128m", "300b", "4k"])
@pytest.mark.parametrize("parts", [1, 3])
def test_round_trip(spark, limit, parts):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, limit)
        assert got(warc.round_trip(frame(spark, ROWS).coalesce(parts))) == expected(ROWS)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_payloads_and_joined_revisits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_IDS", 0)
    path = f"file://{tmp_path}/w"
    warc.write_archives(frame(spark, ROWS).coalesce(1), path)
    rows = warc.read_archives(spark, path, payloads=True).collect()
    for r in rows:
        if r.record_type == "response":
            assert (len(r.payload), base64.b32encode(hashlib.sha1(r.payload).digest()).decode()) == (r.payload_bytes, r.payload_digest)
    assert got(spark.createDataFrame([r[:6] for r in rows], warc.FIELDS)) == expected(ROWS)


def test_binary_payload_and_broken_chain(spark, tmp_path):
    body = bytes(range(256)) + b"WARC/1.1\r\n\xff\xfe"
    rec = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(rec + rec.replace(b":7>", b":8>") + b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 500\r\n\r\ncut off")
    (tmp_path / "b.warc").write_bytes(b"no archive" + rec)
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"file://{tmp_path}", payloads=True).collect()
    assert sorted(r.page_id for r in rows) == [7, 8] and all(bytes(r.payload) == body for r in rows)


def test_empty(spark):
    assert warc.round_trip(frame(spark, ROWS[:1]).limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got(QUERIES["op3_warc_round_trip"](spark, sf)) == expected(rows)
