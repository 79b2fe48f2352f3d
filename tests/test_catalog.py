"""Catalog parsing, configuration, sitemaps, JSON-LD and fetching on cases of their own."""

import json

from pyspark.sql import functions as F

from shelfwatch.sources import catalog, config, fetch, jsonld, sitemap


def responses(spark, *bodies, kind="application/json"):
    return spark.createDataFrame([(i, "https://s.example", kind, b) for i, b in enumerate(bodies)], "pos long, base_url string, content_type string, body string")


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("pos", "item").select(*names).collect()]


def test_json_feed(spark):
    items = [
        {"id": 7, "title": "A", "handle": "a", "variants": [{"title": None, "price": 12.5, "grams": "340", "available": "false"}, "no", {"price": "3", "grams": 250.7, "available": 0}]},
        "no object", {"title": "no url"}, {"id": "", "name": " B ", "url": "/p/b?x", "tags": "Coffee, New"}, {"handle": "c-d", "tags": ["Gone", "x"]}, {"handle": "e", "title": "", "product_type": "Gift"},
    ]
    s = config.Source("S", "https://s.example", exclude_tags=("gone",), exclude_product_types=("gift",))
    got = catalog.parse_json(responses(spark, json.dumps({"products": items}), "broken", json.dumps({"handle": "alone"}), json.dumps([{"handle": "listed"}]), "[]"), s)
    assert rows(got, "product_id", "name", "url")[:2] == [("S:7", "A", "https://s.example/products/a"), (catalog_id("https://s.example/p/b"), "B", "https://s.example/p/b")]
    assert [r[0] for r in rows(got, "name")] == ["A", "B", "Alone", "Listed"]
    v = got.where("product_id = 'S:7'").first().variants
    assert [tuple(x) for x in v] == [("", "12.5", 0, True), ("", "3", 250, False)]


def catalog_id(url):
    import hashlib

    return hashlib.sha256(url.encode()).hexdigest()


def test_path_and_limit(spark):
    body = json.dumps({"a": {"b": [{"slug": f"x{i}", "id": i} for i in range(9)]}, "items": [{"slug": "other"}]})
    s = config.Source("S", "https://s.example", json_items_path=("a", "b"), max_products=3)
    assert [r[0] for r in rows(catalog.parse_json(responses(spark, body), s), "product_id")] == ["S:0", "S:1", "S:2"]
    s = config.Source("S", "https://s.example", json_items_path=("no",))
    assert [r[0] for r in rows(catalog.parse_json(responses(spark, body), s), "name")] == ["Other"]


def test_links(spark):
    page = "<a href='/products/a?x=1'>A <b>one</b></a><a href='/products/a#y'>again</a><a href='/products/b-c'>Quick View</a><a href='/about'>About</a><a href='/products/decaf'>Good</a><a>none</a>"
    s = config.Source("S", "https://s.example", exclude_title_keywords=("decaf",))
    assert rows(catalog.parse_links(responses(spark, page), s), "name", "url") == [("A one", "https://s.example/products/a"), ("B C", "https://s.example/products/b-c")]
    assert rows(catalog.parse_links(responses(spark, page), s, exact=False), "name", "url") == [("A one", "https://s.example/products/a"), ("B C", "https://s.example/products/b-c")]


def test_dispatch(spark):
    s = config.Source("S", "https://s.example", products_parser="wix_shop")
    card = '<a href="/product-page/x-y">q</a><p data-hook="product-item-title">X &amp; Y</p>'
    df = responses(spark, '{"products":[{"handle":"j"}]}').unionByName(responses(spark, "", card, '<a href="/products/k">K</a>', kind="text/html").where("pos > 0"))
    assert rows(catalog.parse_responses(df, s), "name") == [("J",), ("X & Y",), ("K",)]


def test_config(tmp_path, spark):
    p = tmp_path / "s.json"
    p.write_text(json.dumps([{"base_url": "a.example/"}, {"base_url": ""}, 3, {"base_url": "https://b", "enabled": False}, {"base_url": "https://c", "name": "C", "products_type": "XML", "product_link_patterns": [], "json_items_path": "a/b.c", "max_products": 0, "products_params": {"x": 1, "y": None}, "pagination": {"max_pages": 3}}]))
    a, c = config.load_sources(str(p))
    assert (a.name, a.base_url, a.product_link_patterns) == ("https://a.example", "https://a.example", ("/products/", "/product/"))
    assert (c.products_type, c.product_link_patterns, c.json_items_path, c.max_products, c.products_params, c.pagination.max_pages) == ("auto", (), ("a", "b", "c"), 0, {"x": "1"}, 3)
    assert config.load_sources(str(tmp_path / "none")) == []
    s = config.settings({"model": "m", "resume": None}, {"model": "n", "resume": "false", "http_concurrency": "4"})
    assert (s.model, s.resume, s.http_concurrency, s.language) == ("m", False, 4, "zh")
    assert config.settings({}, {"resume": "false"}, compat=True).resume is True
    (tmp_path / "d.txt").write_text("# no\n\n A.example \nb.example:80\na.example\n")
    deny = config.denylist(spark, f"file://{tmp_path}/d.txt")
    assert sorted(r.domain for r in deny.collect()) == ["a.example", "b.example:80"]
    src = spark.createDataFrame([("1", "https://A.example/x"), ("2", "https://b.example"), ("3", "https://b.example:80")], "name string, base_url string")
    assert [r.name for r in config.allowed(src, deny).collect()] == ["2"]
    assert config.merged_headers({"a": "1"}, {"a": "2", "User-Agent": "x"}) == {"a": "2"}


def test_sitemap(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<?xml version='1.0'?><sitemapindex {ns}><sitemap><loc>https://h/store-products-sitemap-1.xml</loc></sitemap><sitemap><loc>https://h/blog.xml</loc></sitemap></sitemapindex>"
    urls = f"<urlset {ns}><url><loc>https://h/p/a/?x</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://h/p/b</loc></url></urlset>"
    files = spark.createDataFrame([("https://h/sitemap.xml", index), ("https://h/store-products-sitemap-1.xml", urls), ("https://h/blog.xml", urls), ("https://h/bad", "<urlset")], "url string, xml string")
    got = sitemap.product_lastmods(files, "https://h", ["/p/"])
    assert sorted(tuple(r) for r in got.collect()) == [("https://h/p/a", "2024-01-02"), ("https://h/p/a/", "2024-01-02")]
    assert sitemap.product_lastmods(files.where("url like '%bad'"), "https://h").count() == 0


def test_jsonld(spark):
    block = lambda x: f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'
    p = {"@type": ["Thing", "PRODUCT"], "name": "N", "brand": {"name": "B"}, "sku": 5, "offers": [[], {"price": 3, "availability": "in"}, {"price": 4}]}
    want = {
        block("broken") + block({"@type": "WebPage", "mainEntity": p}): "Name: N | Brand: B | SKU: 5 | Price: 3 | Availability: in",
        block(json.dumps({"@graph": ["x", {"mainEntityOfPage": p}]}) + " junk"): "Name: N | Brand: B | SKU: 5 | Price: 3 | Availability: in",
        block({"@type": "Product"}) + block([3, {"@type": "ProductGroup", "name": "G"}]): "Name: G",
        block({"@type": "Product", "brand": "Plain", "offers": {"priceCurrency": "EUR"}, "description": " d "}): "Description: d | Brand: Plain",
        "<p>none</p>": "",
    }
    got = spark.createDataFrame([(k,) for k in want], "h string").select(jsonld.jsonld_text(F.col("h")).alias("x")).collect()
    assert [r.x for r in got] == list(want.values())


def test_links_in():
    page = "<!-- <a href='/no'>no</a> --><A class=x HREF=/a title='a > b'>One<b> two </b>&amp; 3</a> <a name=n>none</a><a href='/lost'>lost <a href=\"/b?x=1&amp;y=2\"><script>var a = '<a href=/s>';</script></a><a href='/open'>open"
    assert catalog.links_in(page) == [{"href": "/a", "text": "One two & 3"}, {"href": "/b?x=1&y=2", "text": ""}]


def test_page_text(spark):
    df = spark.createDataFrame([("<p>Plain words. You may like more</p>",), ('<script type="application/ld+json">{"@type":"Product","name":"N"}</script>',)], "h string")
    assert [r.x for r in df.select(jsonld.page_text(F.col("h"), ("you may like",)).alias("x")).collect()] == ["Plain words.", "Name: N"]


def fetcher(answers):
    seen, slept = [], []

    def get(url, headers):
        seen.append(url)
        got = answers.get(url, [])
        return got.pop(0) if len(got) > 1 else got[0] if got else None

    s = config.Settings(jitter_min_s=0.0, jitter_max_s=0.0)
    return fetch.Fetcher(get, s, sleep=slept.append, draw=lambda a, b: b), seen, slept


def test_fetch():
    R = fetch.Response
    f, seen, slept = fetcher({"u": [R(503, headers={"retry-after": "9"}), R(429), R(200, "ok")], "v": [R(404)], "https://h/robots.txt": [R(200, "User-agent: *\nDisallow: /no")]})
    assert f.fetch("u").body == "ok" and slept[0] == 9.0 and len(slept) == 2
    assert f.fetch("v").status == 404 and f.fetch("none") is None and seen.count("none") == 3
    assert f.allows("https://h/x") and not f.allows("https://h/no/x") and not f.allows("/x") and f.allows("https://other/x")


def test_pages():
    R = fetch.Response
    f, seen, _ = fetcher({"https://h/p?page=1": [R(200, "a")], "https://h/p?page=2": [R(200, "")], "https://h/p?page=3": [R(200, "c")]})
    s = config.Source("S", "https://h", products_path="/p", pagination=config.Pages(max_pages=3))
    assert [n for n, _, _ in f.pages(s, bool)] == [1, 2] and "https://h/p?page=3" not in seen


def test_pages_stop_at_the_limit_and_at_empty_ones():
    R = fetch.Response
    two, link = json.dumps({"items": [{"a": 1}, {"a": 2}]}), "<a href='/products/a'>A</a>"
    s = config.Source("S", "https://h", products_path="/p", pagination=config.Pages(max_pages=9), max_products=3)
    f, seen, _ = fetcher({f"https://h/p?page={n}": [R(200, two)] for n in range(1, 9)})
    assert [n for n, _, _ in f.pages(s)] == [1, 2] and "https://h/p?page=3" not in seen
    f, _, _ = fetcher({"https://h/p?page=1": [R(200, link)], "https://h/p?page=2": [R(200, "<p>none</p>")], "https://h/p?page=3": [R(200, link)]})
    assert [n for n, _, _ in f.pages(s)] == [1, 2]
    f, _, _ = fetcher({"https://h/p?page=1": [R(200, "[]")], "https://h/p?page=3": [R(200, two)]})
    more = config.Source("S", "https://h", products_path="/p", pagination=config.Pages(max_pages=3, stop_on_empty=False))
    assert [n for n, _, _ in f.pages(more)] == [1, 3]


def test_a_transport_that_throws(spark):
    """Its source has no rows, the others have theirs."""
    from http.client import IncompleteRead

    def transport():
        def get(url, headers):
            if "robots" in url:
                return fetch.Response(404)
            if "cut" in url:
                raise IncompleteRead(b"x")
            if "odd" in url:
                raise LookupError("unknown encoding: x-odd")
            return fetch.Response(200, "{}", {})

        return get

    sources = [config.Source(n, f"https://{n}.example") for n in ("fine", "cut", "odd", "good")]
    settings = config.Settings(jitter_min_s=0.0, jitter_max_s=0.0, http_concurrency=2)
    assert sorted(r.source for r in fetch.capture(spark, sources, settings, transport).collect()) == ["fine", "good"]


def test_http_of_odd_servers():
    """A charset that nobody knows, a body cut short, an error page: an answer or None, never an exception."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Odd(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "missing" in self.path else 200)
            self.send_header("Content-Type", "text/html; charset=x-odd" if "odd" in self.path else "text/html; charset=latin-1")
            self.send_header("Content-Length", "99" if "cut" in self.path else "2")
            self.end_headers()
            self.wfile.write("é".encode() if "odd" in self.path else b"\xe9x")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Odd)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get, at = fetch.http(5.0), f"http://127.0.0.1:{server.server_port}"
    try:
        assert get(f"{at}/odd", {}).body == "é" and get(f"{at}/plain", {}).body == "éx"
        assert get(f"{at}/cut", {}) is None and get(f"{at}/missing", {}).status == 404 and get(f"{at}/missing-cut", {}).status == 404
    finally:
        server.shutdown()
