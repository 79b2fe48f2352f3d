"""Robots rules by a join, as the standard library's parser decides."""

from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pytest

from shelfwatch.sources import robots

FILES = {
    "https://a": (200, "User-agent: *\nDisallow: /private\nAllow: /private/open\nAllow: /shop\nDisallow: /sh"),
    "http://a": (200, "User-agent: other\nDisallow: /\n\nUser-agent: Watcher\nAllow: /x/y\nDisallow: /x\n\nUser-agent: *\nDisallow: /z?q="),
    "https://b:8080": (200, "User-agent: *\nDisallow:\n"),
    "https://c": (503, "User-agent: *\nDisallow: /"),
    "https://d": (200, "User-agent: *\nDisallow: *\n"),
    "https://e": (200, "no rules at all <html>"),
    "https://f": (None, None),
    "https://g": (200, "User-agent: *\nDisallow: /caf%C3%A9\nDisallow: /a b\nDisallow: /%7Ejoe"),
}
PATHS = ["", "/", "/private", "/private/open", "/shop/1", "/shirt", "/x/y/1", "/x", "/z?q=1", "/z", "/caf%C3%A9/1", "/café", "/a%20b", "/~joe/", "/%7Ejoe", "/p;v=1?x=2#f"]


@pytest.mark.parametrize("agent", ["*", "watcher/2.0"])
def test_as_the_standard_library(spark, agent):
    found = [o + p for o in [*FILES, "https://unknown"] for p in PATHS]
    odd = ["", "no url", "/only/path", "https:///none", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*found, *odd])], "id int, url string")
    table = robots.rules(spark.createDataFrame([(o, s, b) for o, (s, b) in FILES.items()], "origin string, status int, body string"), agent)
    got = {r.id: r.allowed for r in robots.decided(rows.repartition(3), table).collect()}
    for i, u in enumerate(found):
        parts = urlsplit(u)
        status, body = FILES.get(f"{parts.scheme}://{parts.netloc}", (None, None))
        parser = RobotFileParser()
        parser.parse((body or "").splitlines() if status is not None and status < 400 else [])
        assert got[i] == parser.can_fetch(agent, u), u
    assert [got[len(found) + k] for k in range(len(odd))] == [False] * len(odd)
