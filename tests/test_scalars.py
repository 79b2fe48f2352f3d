"""URL, text and date scalars against the standard library, on the cases that differ between dialects."""

import hashlib
import re
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from shelfwatch.functions import dates, text, urls
from shelfwatch.functions.hashing import seen_hash


def values(spark, rows, column):
    """column over rows (x), in order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]).toDF("i", *"xyz"[: len(rows[0]) if isinstance(rows[0], tuple) else 1])
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


URLS = ["https://h/a/b?x=1#y", "http://h", "http://h/", "https://h/a#x?y", "/a/b?c", "a/b", "", "https://h:80/p/?q", "mailto:x@y", "https://h/a b"]


def test_canonical_and_parts(spark):
    assert values(spark, URLS, urls.canonical(F.col("x"))) == [urlunsplit((*urlsplit(u)[:3], "", "")) for u in URLS]
    assert values(spark, URLS, urls.path(F.col("x"))) == [urlsplit(u).path for u in URLS]
    assert values(spark, URLS, urls.host(F.col("x"))) == [urlsplit(u).netloc for u in URLS]


def test_base(spark):
    given = ["  example.com/shop/ ", "https://h/", "//h/x?y#z", "http://h/a//", "", "example.com:8080"]
    assert values(spark, given, urls.base(F.col("x"))) == ["https://example.com/shop", "https://h", "https://h/x", "http://h/a", "", "example.com:8080"]


def test_joined(spark):
    pairs = [(b, r) for b in ("https://h/a/b?q#f", "http://h", "https://h/a/") for r in ("", "c", "/c", "//k/c", "?z", "#z", "../c", "./c", "c/../d", "/a/./b/../c", "https://k/x", "mailto:a@b", "..", "c?x=/../y")]
    assert values(spark, pairs, urls.joined(F.col("x"), F.col("y"))) == [urljoin(b, r) for b, r in pairs]


def test_resolved(spark):
    rows = [("", "h1", "7"), ("/p/x?v=1", "h", "7"), ("foo", "h", "7"), ("", "", "7"), ("", "", "")]
    c = lambda t: urls.resolved(F.lit("https://s"), F.col("x"), F.col("y"), F.col("z"), t)
    assert values(spark, rows, c(None)) == ["https://s/products/h1", "https://s/p/x", "foo", "", ""]
    assert values(spark, rows, c("https://t/{handle}/{id}/{slug}")) == ["https://t/h1/7/h1", "https://s/p/x", "foo", "https://t//7/", ""]
    assert values(spark, rows, c("/{other}"))[0] == "https://s/products/h1"


def test_slug_and_name(spark):
    assert values(spark, [" Ab  c!d ", "--", "É1"], urls.slug(F.col("x"))) == ["ab-c-d", "roaster", "1"]
    given = ["https://h/p/it's-a_b", "https://h", "https://h/a/--/", "https://h/x/new-york2go/?q"]
    want = [(urlsplit(u).path.rstrip("/").split("/")[-1].replace("-", " ").replace("_", " ").strip().title() or "Unknown Coffee") for u in given]
    assert values(spark, given, urls.name_from(F.col("x"))) == want


def test_matches(spark):
    given = ["https://h/products/a", "https://h/products/gift", "https://h/x"]
    assert values(spark, given, urls.matches(F.col("x"), ["/products/"], ["re:gift$", "re:("])) == [True, False, False]
    assert values(spark, given, urls.matches(F.col("x"), [], [])) == [True] * 3


def test_with_params():
    assert urls.with_params("https://h/s", "/p.json?page=1&x=&y=2", {"page": "3"}) == "https://h/s/p.json?page=3&y=2"
    assert urls.with_params("https://h", "https://k/p#f", {}) == "https://k/p#f"


TEXTS = ["a  b\t\n c", " x", "write to a.b+c@d-e.org now", "call +1 (555) 123-4567 or 12 345 678", "zero​width\x07bell", "", "＋１２３"]


def test_text(spark):
    clean = lambda s: "".join(c for c in " ".join(s.split()) if c.isprintable())
    assert values(spark, TEXTS, text.field(F.col("x"))) == [clean(s) for s in TEXTS]
    assert values(spark, TEXTS, text.field(F.col("x"), 3)) == [clean(s)[:3] for s in TEXTS]

    def phone(s):
        return re.sub(r"(?:\+?[\d][\d\s().-]{7,}\d)", lambda m: "[redacted phone]" if len(re.sub(r"\D", "", m[0])) >= 10 else m[0], s)

    assert values(spark, TEXTS, text.redact_phone(F.col("x"))) == [phone(s) for s in TEXTS]
    assert values(spark, TEXTS, text.redact_email(F.col("x")))[2] == "write to [redacted email] now"


def test_trimmed_at(spark):
    assert values(spark, ["Good. You may ALSO like this", "none", "also"], text.trimmed_at(F.col("x"), ("you may also", " ", "also"))) == ["Good.", "none", ""]
    assert values(spark, ["x y"], text.trimmed_at(F.col("x"), ())) == ["x y"]


def test_sanitized(spark):
    page = "<head><title>t</title></head><body><p>Fine beans</p><p>Add to CART now</p><script>x</script><div>R&amp;D <b>team</b></div><li>me@x.org</li>"
    assert values(spark, [page], text.sanitized(F.col("x"))) == ["Fine beans R&D team [redacted email]"]
    assert values(spark, [page], text.sanitized(F.col("x"), 0, False)) == ["Fine beans Add to CART now R&D team [redacted email]"]


ISO = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T23:30:00-02:00", "2024-01-02 10", "20240102", "2024", "2024-1-2", "", "x", "2024-13-01", "2024-01-02T03:04:05.123456+00:00", "2024-01-02T03:04+0530"]


def test_iso_date(spark):
    from datetime import datetime, timezone

    def want(s):
        try:
            d = datetime.fromisoformat(s.strip().removesuffix("Z") + "+00:00" * s.strip().endswith("Z"))
        except ValueError:
            return None
        return (d if d.tzinfo else d.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).date()

    assert values(spark, ISO, dates.iso_date(F.col("x"))) == [want(s) for s in ISO]


def test_http_date(spark):
    from datetime import date

    given = ["Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 23:30:00 -0200", "Mon, 02 Jan 2024 03:04:05 GMT", "02 Jan 2024 03:04:05", "", "soon"]
    assert values(spark, given, dates.http_date(F.col("x"))) == [date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 2), date(2024, 1, 2), None, None]


@pytest.mark.parametrize("days, first", [(7, 24), (1, 30), (0, 30), (-5, 30)])
def test_window(spark, days, first):
    given = [f"2024-01-{d}" for d in range(20, 32)]
    inside = values(spark, given, dates.in_window(F.to_date("x"), F.to_date(F.lit("2024-01-30")), days))
    assert [g for g, ok in zip(given, inside) if ok] == [f"2024-01-{d}" for d in range(first, 31)]


def test_seen_hash(spark):
    rows = [(" u ", "t", "d\n"), ("é", "", "x"), ("", "", "")]
    want = [hashlib.sha3_512("\n".join(s.strip() for s in r).encode()).hexdigest() for r in rows]
    assert values(spark, rows, seen_hash(F.col("x"), F.col("y"), F.col("z"))) == want


def test_variant_lines(spark):
    df = spark.sql("select array(named_struct('title','bag','price','9','grams',250,'available',true), named_struct('title','','price','','grams',0,'available',false)) v union all select array() v")
    assert sorted(map(tuple, (r.x for r in df.select(text.variant_lines(F.col("v")).alias("x")).collect()))) == [(), ("  variants:", "    - bag | $9 | 250g | available", "    - unavailable")]
