"""Queries over what surrounds the catalog's parse: configurations, fetching, reports, digests, responses of text generation.

They run the engine's own functions over the driver's tables, as shelfwatch.queries does, and register themselves there.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import dates, text
from shelfwatch.operators import classify, keywords, render, seen
from shelfwatch.plans import evaluator, run
from shelfwatch.queries import CANON, SPLIT, observations, query, seen_rows, table
from shelfwatch.sources import catalog, config, fetch, reports, robots, rules, sitemap

RUN_ID = "20240130"
BIG = 2**31 - 1


def text_of(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


@query("SELECT DISTINCT lower(trim(CASE WHEN p_size % 3 = 0 THEN '# ' || p_name WHEN p_size % 3 = 1 THEN '  ' || p_type ELSE upper(p_name) || ' ' END)) AS domain FROM part WHERE p_size % 3 <> 0")
def denied_domains(spark, sf):
    line = F.when(F.col("p_size") % 3 == 0, text_of("# ", F.col("p_name"))).when(F.col("p_size") % 3 == 1, text_of("  ", F.col("p_type"))).otherwise(text_of(F.upper("p_name"), " "))
    return config.domains(table(spark, sf, "part").select(line.alias("value")))


@query("""SELECT p_partkey AS pos, CASE p_partkey % 4 WHEN 3 THEN 'https://s/products/q' ELSE 'https://s/products/p' END || p_partkey AS url, CASE p_partkey % 4 WHEN 1 THEN 'Card ' || p_name ELSE p_name END AS name,
  CASE p_partkey % 4 WHEN 1 THEN '$7.00' ELSE '' END AS list_price FROM part WHERE p_partkey % 4 <> 1
UNION ALL SELECT p_partkey, 'https://s/product-page/p' || p_partkey, 'Card ' || p_name, '$7.00' FROM part WHERE p_partkey % 4 = 1""")
def dispatched_responses(spark, sf):
    """Responses by what they are: JSON feeds, broken JSON that is a page, pages with cards for the registered parser, link listings."""
    k, name = F.col("p_partkey"), F.col("p_name")
    feed = F.to_json(F.named_struct(F.lit("products"), F.array(F.named_struct(F.lit("title"), name, F.lit("handle"), text_of("p", k)))))
    link = text_of("<p><a href='/products/", F.when(k % 4 == 3, "q").otherwise("p"), k, "'>", name, "</a></p>")
    card = text_of("<a href='/product-page/p", k, "'>x</a><h3 data-hook='product-item-title'>Card ", name, "</h3><i>$7.00</i>")
    body = F.when(k % 4 == 0, feed).when(k % 4 == 1, card).otherwise(link)
    rows = table(spark, sf, "part").select(k.alias("pos"), F.lit("https://s").alias("base_url"), F.when(k % 4 == 0, "application/JSON; charset=utf-8").when(k % 4 == 2, "text/json").otherwise("text/html").alias("content_type"), body.alias("body"))
    return catalog.parse_responses(rows, config.Source("s", "", products_parser="wix_shop", max_products=BIG)).select("pos", "url", "name", "list_price")


@query("SELECT p_partkey, p_name AS name, 'https://s/products/h' || p_partkey AS url FROM part WHERE p_size % 2 = 0")
def items_by_path(spark, sf):
    """Feeds whose list stands under a path; items without any URL are left out."""
    item = F.named_struct(F.lit("label"), F.col("p_name"), F.lit("slug"), F.when(F.col("p_size") % 2 == 0, text_of("h", F.col("p_partkey"))))
    body = F.to_json(F.named_struct(F.lit("data"), F.named_struct(F.lit("list"), F.array(item)), F.lit("items"), F.array(F.named_struct(F.lit("label"), F.lit("no")))))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.lit("https://s").alias("base_url"), body.alias("body"))
    source = config.Source("s", "", json_items_path=("data", "list"), product_fields=config.Fields(name=("none", "label")), max_products=BIG)
    return catalog.parse_json(rows, source).select(F.col("pos").alias("p_partkey"), "name", "url")


@query("SELECT p_partkey AS pos, 'https://s/product-page/' || replace(p_name, ' ', '-') AS url FROM part WHERE NOT contains(p_name, 'red') AND NOT contains(p_name, 'blue ')")
def card_keywords(spark, sf):
    """Shop cards without those whose name or path has an excluded keyword, in words or with hyphens."""
    page = text_of("<a href='/product-page/", F.replace("p_name", F.lit(" "), F.lit("-")), "'>v</a><h3 data-hook='product-item-title'>", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise("plain"), "</h3>")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.lit("https://s").alias("base_url"), page.alias("body"))
    return catalog.parse_cards(rows, config.Source("s", "", exclude_title_keywords=("Red", "blue "), max_products=BIG)).select("pos", "url")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(CASE WHEN p_size % 2 = 0 THEN [upper(p_type), ' ' || p_name || ' ', '', p_type] ELSE str_split(upper(p_type) || ', ,' || p_name || ',' || p_type, ',') END, lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS tags FROM part")
def normalized_tags(spark, sf):
    listed = F.to_json(F.named_struct(F.lit("tags"), F.array(F.upper("p_type"), text_of(" ", F.col("p_name"), " "), F.lit(""), F.col("p_type"))))
    told = F.to_json(F.named_struct(F.lit("tags"), text_of(F.upper("p_type"), ", ,", F.col("p_name"), ",", F.col("p_type"))))
    v = F.try_parse_json(F.when(F.col("p_size") % 2 == 0, listed).otherwise(told))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(catalog.tags_of(v)), "|").alias("tags"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND lang = 'de' OR doc_id % 3 = 1 AND lang = 'en' THEN 'zh' ELSE 'en' END AS language FROM documents")
def report_languages(spark, sf):
    value = F.when((F.col("doc_id") % 3 == 0) & (F.col("lang") == "de"), " Zh-CN ").when((F.col("doc_id") % 3 == 1) & (F.col("lang") == "en"), "SIMPLIFIED").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", text.language(value).alias("language"))


@query("""SELECT n_name AS name, 'https://h' || n_nationkey || '.example/shop' AS base_url, n_nationkey % 7 AS max_products, CASE n_nationkey % 3 WHEN 0 THEN 'json' ELSE 'auto' END AS products_type,
  CASE n_nationkey % 2 WHEN 0 THEN n_name ELSE n_name || ',x' END AS include_tags, 'a.b' AS items_path, 'v=' || n_nationkey AS params, '/products/,/product/' AS patterns, n_regionkey + 1 AS max_pages, 'own,title' AS names
FROM nation WHERE n_nationkey % 5 <> 0""")
def source_configs(spark, sf):
    """Source configurations in the spellings that files use, one for each nation."""
    entries = [
        {"name": r.n_name, "base_url": f" h{r.n_nationkey}.example/shop//?q#f", "enabled": r.n_nationkey % 5 != 0, "max_products": str(r.n_nationkey % 7), "products_type": "JSON" if r.n_nationkey % 3 == 0 else "other",
         "include_tags": r.n_name if r.n_nationkey % 2 == 0 else [r.n_name, "", "x"], "json_items_path": "a/b" if r.n_nationkey % 2 == 0 else ["a", "", "b"], "products_params": {"v": r.n_nationkey, "none": None},
         "product_link_patterns": 5, "pagination": {"max_pages": str(r.n_regionkey + 1)}, "product_fields": {"name_fields": ["own", "title"], "url": []}}
        for r in table(spark, sf, "nation").collect()
    ]
    rows = [(s.name, s.base_url, s.max_products, s.products_type, ",".join(s.include_tags), ".".join(s.json_items_path), ",".join(f"{k}={v}" for k, v in s.products_params.items()), ",".join(s.product_link_patterns), s.pagination.max_pages, ",".join(s.product_fields.name)) for s in map(config.source_of, entries) if s]
    return spark.createDataFrame(rows, "name string, base_url string, max_products int, products_type string, include_tags string, items_path string, params string, patterns string, max_pages int, names string")


@query("""WITH k AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source, regexp_extract(text, '[a-z]{4,}') AS word FROM documents WHERE regexp_extract(text, '[a-z]{4,}') <> '')
SELECT doc_id, string_agg(DISTINCT word, '|' ORDER BY word) AS hits FROM documents d JOIN k ON contains(text, word) AND (k.source IS NULL OR k.source = d.source) GROUP BY doc_id""")
def keyword_tables(spark, sf):
    """Each source's keywords, the first words of its documents, and some for all sources, sought in all texts in one pass."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    words = docs.select(F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), F.regexp_extract("text", "[a-z]{4,}", 0).alias("keyword"))
    found = keywords.with_hits(docs, F.col("text"), F.col("source"), words).where(F.size("hits") > 0)
    return found.select("doc_id", F.array_join("hits", "|").alias("hits"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin, substr(url, length(regexp_extract(url, '^[a-z]+://[^/?#]+')) + 1) AS path FROM pages)
SELECT page_id, NOT CASE length(origin) % 4 WHEN 0 THEN starts_with(path, '/en/') AND NOT starts_with(path, '/en/1') WHEN 1 THEN contains(substr(path, 1, 3), '/de') WHEN 2 THEN false ELSE NOT starts_with(path, '/fr/') END AS allowed FROM p""")
def robots_by_host(spark, sf):
    """Each page's URL held against the robots.txt of its origin, of which there are four kinds, one of them an error's."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    kind = F.length("origin") % 4
    body = F.when(kind == 0, "User-agent: *\nAllow: /en/1\nDisallow: /en/").when(kind == 1, "User-agent: *\nDisallow: /de").otherwise("User-agent: *\nAllow: /fr/\nDisallow: /")
    files = pages.select(robots.origin_of(F.col("url")).alias("origin")).distinct().select("origin", F.when(kind == 2, 404).otherwise(200).alias("status"), body.alias("body"))
    return robots.decided(pages, robots.rules(files)).select("page_id", "allowed")


def customer_entries(spark, sf) -> DataFrame:
    """A configuration entry for each customer, in the spellings that files use."""
    k, segment = F.col("c_custkey"), F.lower("c_mktsegment")
    entry = F.named_struct(
        *(x for n, v in {
            "name": F.col("c_name"), "base_url": text_of(" c", k, ".example/shop//?q#f"), "enabled": k % 7 != 0, "max_products": F.when(k % 2 == 0, (k % 4).cast("string")),
            "products_type": F.when(k % 3 == 0, "JSON").when(k % 3 == 1, "html").otherwise("any"), "json_items_path": F.when(k % 2 == 0, "a/list").otherwise("a.list"),
            "exclude_title_keywords": F.array(text_of(" ", segment), F.lit("")), "product_link_patterns": F.array(text_of("re:/o/\\d*[", k % 10, "5]$"), F.lit("re:(")),
            "product_fields": F.struct(F.array(F.lit("none"), F.lit("label")).alias("name_fields")), "product_url_template": F.lit("/o/{id}?x"), "platform": F.col("c_mktsegment"),
        }.items() for x in (F.lit(n), v))
    )
    return table(spark, sf, "customer").select(k.alias("pos"), F.to_json(entry).alias("entry"))


@query("""SELECT c_custkey AS pos, c_name AS name, 'https://c' || c_custkey || '.example/shop' AS base_url, lower(c_mktsegment) AS platform, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 4)::INT END AS max_products,
  CASE c_custkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'html' ELSE 'auto' END AS products_type, 'a.list' AS items_path, ' ' || lower(c_mktsegment) AS words, 'none,label' AS names, 'url,product_url' AS urls, 1 AS max_pages
FROM customer WHERE c_custkey % 7 <> 0""")
def source_rules(spark, sf):
    """Configuration entries as a table of sources: one for each customer that is enabled."""
    r = rules.from_entries(customer_entries(spark, sf)).select("pos", "rule.*")
    joined = lambda xs: F.array_join(xs, ",")
    return r.select("pos", "name", "base_url", "platform", "max_products", "products_type", F.array_join("json_items_path", ".").alias("items_path"), joined("exclude_title_keywords").alias("words"), joined(F.col("product_fields.name")).alias("names"), joined(F.col("product_fields.url")).alias("urls"), F.col("pagination.max_pages").alias("max_pages"))


@query("""WITH s AS (SELECT c_custkey AS k, c_name AS source, 'https://c' || c_custkey || '.example' AS host, lower(c_mktsegment) AS word, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN c_custkey % 4 ELSE 3 END AS most FROM customer WHERE c_custkey % 7 <> 0),
o AS (SELECT s.*, o_orderkey, o_orderkey % 2 AS pos, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || ' ' || word ELSE o_orderpriority END AS label FROM orders JOIN s ON o_custkey = k),
r AS (SELECT *, host || '/o/' || o_orderkey AS url, row_number() OVER (PARTITION BY k, pos ORDER BY o_orderkey) - 1 AS item FROM o),
f AS (SELECT * FROM r WHERE o_orderkey % 4 <> 0 AND (k % 3 <> 1 OR o_orderkey % 10 IN (k % 10, 5)))
SELECT source, pos, item::INT AS item, label AS name, url, word AS platform FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, item) AS n FROM f) WHERE n <= most""")
def products_by_rule(spark, sf):
    """Feeds and link listings of as many sources as there are customers, two responses each, parsed by their rules in one scan."""
    key, k = F.col("o_orderkey"), F.col("c_custkey")
    shown = F.when(key % 4 == 0, text_of(F.col("o_orderpriority"), " ", F.lower("c_mktsegment"))).otherwise(F.col("o_orderpriority"))
    item = F.struct(shown.alias("label"), F.when(key % 4 == 0, shown).alias("title"), key.alias("id"))
    link = text_of("<a href='/o/", key, "'>", shown, "</a>")
    both = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == k)
    pages = both.groupBy("c_name", k, (key % 2).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), item.alias("item"), link.alias("link")))).alias("rows"))
    feed = F.to_json(F.struct(F.struct(F.transform("rows", lambda x: x["item"]).alias("list")).alias("a")))
    body = F.when(k % 3 == 1, F.array_join(F.transform("rows", lambda x: x["link"]), "")).otherwise(feed)
    responses = pages.select(F.col("c_name").alias("source"), "pos", text_of("https://c", k, ".example").alias("base_url"), F.lit("application/json").alias("content_type"), body.alias("body"))
    return rules.parse(responses, rules.from_entries(customer_entries(spark, sf)), 3).select("source", "pos", "item", "name", "url", "platform")


@query("SELECT r_name, CASE r_regionkey % 2 WHEN 0 THEN r_name ELSE 'file' END AS model, r_regionkey AS http_concurrency, r_regionkey % 2 = 1 AS resume, 'zh' AS language FROM region")
def merged_settings(spark, sf):
    """Settings of a command line over those of a file over defaults, one case for each region."""
    rows = []
    for r in table(spark, sf, "region").collect():
        s = config.settings({"model": r.r_name if r.r_regionkey % 2 == 0 else None}, {"model": "file", "http_concurrency": str(r.r_regionkey), "resume": "true" if r.r_regionkey % 2 else "false"})
        rows.append((r.r_name, s.model, s.http_concurrency, s.resume, s.language))
    return spark.createDataFrame(rows, "r_name string, model string, http_concurrency int, resume boolean, language string")


@query("SELECT n_nationkey, 'https://h/shop/p.json?keep=1&page=' || n_nationkey || '&q=a+b' AS url, 'own=1,' || CASE WHEN n_nationkey % 2 = 0 THEN 'x=b' ELSE 'x=a' END AS headers FROM nation")
def request_urls(spark, sf):
    """URLs and headers of requests, one for each nation."""
    from shelfwatch.functions.urls import with_params

    rows = []
    for r in table(spark, sf, "nation").collect():
        headers = config.merged_headers({"own": "1", "x": "a"}, {"USER-agent": "mine"} | ({"x": "b"} if r.n_nationkey % 2 == 0 else {}))
        rows.append((r.n_nationkey, with_params("https://h/shop/", "p.json?keep=1&page=0&blank=#f", {"page": r.n_nationkey, "q": "a b"}), ",".join(f"{k}={v}" for k, v in headers.items())))
    return spark.createDataFrame(rows, "n_nationkey int, url string, headers string")


def site(names: dict[str, int]):
    """A transport: host hK has K + 1 pages of two products, host h3 lets no one in, and h1 fails once for each page."""
    failed = set()

    def get(url: str, headers: dict[str, str]) -> fetch.Response:
        host, _, path = url.removeprefix("https://").partition("/")
        k = int(host[1:])
        if path == "robots.txt":
            return fetch.Response(200, "User-agent: *\nDisallow: /") if k == 3 else fetch.Response(404)
        if k == 1 and url not in failed:
            failed.add(url)
            return fetch.Response(503, headers={"retry-after": "0"})
        n = int(path.partition("page=")[2])
        return fetch.Response(200, json.dumps({"items": [{"id": n}, {"id": -n}] if n <= k + 1 else []}), {"content-type": "application/json"})

    return get


@query("SELECT r_name AS source, n::BIGINT AS pos, 'https://h' || r_regionkey || '/p.json?page=' || n AS url, CASE WHEN n <= r_regionkey + 1 THEN 2 ELSE 0 END AS products FROM region, range(1, 5) t(n) WHERE r_regionkey <> 3 AND n <= r_regionkey + 2")
def fetched_pages(spark, sf):
    """Paged catalogs of a site: up to the first empty page, with robots.txt and another try where it pays."""
    names = {r.r_name: r.r_regionkey for r in table(spark, sf, "region").collect()}
    sources = [config.Source(n, f"https://h{k}", products_path="/p.json", pagination=config.Pages(max_pages=4)) for n, k in names.items()]
    got = fetch.capture(spark, sources, config.Settings(jitter_min_s=0.0, jitter_max_s=0.0, http_concurrency=4), lambda: site(names))
    return got.select("source", "pos", "url", F.size(F.try_variant_get(F.try_parse_json("body"), "$.items", "array<variant>")).alias("products"))


@query(f"""WITH u AS (SELECT page_id % 3 AS file, page_id, {CANON} AS url, '2024-02-' || lpad((1 + page_id % 28)::varchar, 2, '0') AS lastmod FROM pages),
a AS (SELECT * FROM u UNION ALL SELECT file, page_id, regexp_replace(url, '/+$', ''), lastmod FROM u WHERE regexp_matches(url, '://[^/]+/.*/$'))
SELECT url, arg_max(lastmod, (file, page_id)) AS lastmod FROM a WHERE NOT contains(url, '/en/') GROUP BY url""")
def walked_sitemaps(spark, sf):
    """An index with three product sitemaps and another one that doesn't count, walked; of a URL's dates the last read holds."""
    loc = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = text_of("<url><loc>", loc, "</loc><lastmod>2024-02-", F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0"), "</lastmod></url>")
    files = table(spark, sf, "pages").groupBy((F.col("page_id") % 3).alias("k")).agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("x")))).alias("xs"))
    files = files.select(text_of("https://s/store-products-sitemap-", F.col("k"), ".xml").alias("url"), text_of("<urlset>", F.array_join(F.transform("xs", lambda x: x["x"]), ""), "</urlset>").alias("xml"))
    index = "".join(f"<sitemap><loc>https://s/{n}</loc></sitemap>" for n in ("store-products-sitemap-0.xml", "blog.xml", "store-products-sitemap-1.xml", "store-products-sitemap-2.xml"))
    more = spark.createDataFrame([("https://s/sitemap.xml", f"<sitemapindex>{index}</sitemapindex>"), ("https://s/blog.xml", "<urlset><url><loc>https://s/blog</loc><lastmod>2024</lastmod></url></urlset>")], "url string, xml string")
    return sitemap.product_lastmods(files.unionByName(more), "https://s", (), ("/en/",))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'Page of ' || p_name ELSE '' END AS page_text, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 0 AND p_partkey % 5 <> 0 THEN 'm' ELSE '' END AS modified FROM part")
def joined_page_texts(spark, sf):
    """Page texts of the products that need their page, cut at their source's stop phrases."""
    k = F.col("p_partkey")
    products = table(spark, sf, "part").select("p_partkey", F.lit("s").alias("source"), text_of("https://s/", k).alias("url"), F.when(F.col("p_size") % 2 == 0, "").otherwise("<p>own</p>").alias("body_html"), F.when(F.col("p_size") % 3 == 0, "shopify").otherwise("wix").alias("platform"))
    pages = table(spark, sf, "part").where(k % 5 != 0).select(text_of("https://s/", k).alias("url"), text_of("<div>Page of ", F.col("p_name"), "</div><p>See also: more</p>").alias("html"), F.lit("m").alias("modified"))
    return run.with_page_text(products, pages, 0, {"s": ("SEE ALSO",)}).select("p_partkey", "page_text", "modified")


@query("""WITH d AS (SELECT user_id, arg_max(props, (ts, event_id)) FILTER (event_type = 'view') AS description, arg_max(event_id::varchar, (ts, event_id)) FILTER (event_type = 'click') AS modified, arg_max(strftime(ts, '%Y-%m-%d %H:%M:%S'), (ts, event_id)) FILTER (event_type = 'error') AS lastmod FROM events GROUP BY user_id)
SELECT event_id, coalesce(description, '') AS description, coalesce(modified, '') AS modified, coalesce(lastmod, '') AS lastmod FROM events JOIN d USING (user_id)""")
def described_products(spark, sf):
    """Descriptions, page dates and sitemap dates by URL, of which the last of each holds."""
    events = table(spark, sf, "events").withColumns({"url": F.col("user_id").cast("string"), "pos": F.struct("ts", "event_id")})
    of = lambda kind, value, name: events.where(F.col("event_type") == kind).select("url", value.alias(name), "pos")
    products = events.select("event_id", "url", F.col("event_type").alias("name"), F.lit("").alias("shopify_published_at"))
    out = classify.described(products, of("view", F.col("props"), "description"), of("click", F.col("event_id").cast("string"), "modified"), of("error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "lastmod"))
    return out.select("event_id", "description", "modified", "lastmod")


@query("""WITH r AS (SELECT concat_ws('|', user_id, event_type) AS hash, ts, event_id FROM events)
SELECT hash, arg_max('u' || event_id, (ts, event_id)) AS url, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first_seen_at FROM r GROUP BY hash""")
def store_replayed(spark, sf):
    """Batches folded into a store, the last of them twice, as after a failure: nothing changes."""
    events, store = table(spark, sf, "events"), spark.createDataFrame([], seen.SCHEMA)
    cut = F.lit("2024-01-15").cast("timestamp")
    for part in (events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut), events.where(F.col("ts") >= cut)):
        store = seen.merged(store, seen_rows(part))
    return store.select("hash", "url", "first_seen_at")


def shared_folder(spark, name: str) -> str:
    """A new folder that driver and executors share, gone with the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shelfwatch-")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/shelfwatch/{name}-{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return at.toString()


@query("""WITH r AS (SELECT concat_ws('|', user_id, event_type) AS hash, ts, event_id, 'u' || event_id AS url, event_type AS title, props AS description,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS s, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'r' || event_id END AS r FROM events)
SELECT hash, arg_max(url, (ts, event_id)) AS url, arg_max(title, (ts, event_id)) AS title, arg_max(description, (ts, event_id)) AS description,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first_seen_at, coalesce(arg_max(s, (ts, event_id)) FILTER (s <> ''), '') AS shopify_updated_at,
  coalesce(arg_max(r, (ts, event_id)) FILTER (r <> ''), '') AS roaster, 'p' AS platform FROM r GROUP BY hash""")
def stored_in_buckets(spark, sf):
    """A store of bucketed files after three upserts, the last of them twice."""
    events, store = table(spark, sf, "events"), seen.SeenStore(spark, shared_folder(spark, "store"), buckets=8)
    first, second = (F.lit(d).cast("timestamp") for d in ("2024-01-10", SPLIT))
    last = seen_rows(events.where(F.col("ts") >= second))
    for part in (seen_rows(events.where(F.col("ts") < first)), seen_rows(events.where((F.col("ts") >= first) & (F.col("ts") < second))), last, last):
        store.upsert(part)
    return store.read()


@query("SELECT hash, '' AS url, '' AS title, CASE WHEN n % 2 = 0 THEN '' ELSE 'd' END AS description, '' AS first_seen_at, '' AS shopify_updated_at, '' AS roaster, '' AS platform FROM (SELECT concat_ws('|', user_id, event_type, props) AS hash, count(*) AS n FROM events GROUP BY ALL)")
def store_of_older_columns(spark, sf):
    """A snapshot that lacks columns and has nulls, as the store reads it."""
    old = observations(spark, sf).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).select("hash", F.when(F.col("n") % 2 == 1, "d").alias("description"), F.lit(1).alias("unknown"))
    return seen.filled(old)


def report_rows(spark, sf) -> DataFrame:
    """(file_name, text): a report for each labelled document, and files that are none."""
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, f"{RUN_ID}-z-digest.md").when(k % 4 == 1, text_of("20240129-d", k, ".md")).otherwise(text_of(f"{RUN_ID}-d", k, ".md"))
    return table(spark, sf, "labels").select("doc_id", name.alias("file_name"), F.when(F.col("quality") == 0, " \n ").otherwise(text_of("\n report ", k, " \n")).alias("value"))


@query(f"SELECT '{RUN_ID}-d' || doc_id || '.md' AS file_name, 'report ' || doc_id AS text FROM labels WHERE doc_id % 4 > 1 AND quality <> 0")
def readable_reports(spark, sf):
    """The run's reports: no digests, no other day's, none that is blank."""
    return reports.readable(report_rows(spark, sf).select("file_name", "value"), RUN_ID)


@query(f"SELECT p_partkey, '{RUN_ID}-' || lower(replace(p_brand, '#', '-')) || '.md' AS report, '{RUN_ID}-' || replace(p_name, ' ', '-') || '.prompt.txt' AS prompt FROM part")
def report_file_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", reports.file_name(RUN_ID, F.col("p_brand")).alias("report"), reports.file_name(RUN_ID, F.col("p_name"), "prompt", "txt").alias("prompt"))


@query("""SELECT conv_id, turn, '# Catalog Report' || chr(10) || chr(10) || 'Roaster: ' || role || chr(10) || 'Generated: now' || chr(10) || 'Run: 20240130' || chr(10) || chr(10) || '## Recommendations' || chr(10) || chr(10)
  || CASE WHEN turn % 2 = 0 THEN 'note' || chr(10) ELSE '' END || text || chr(10) || 'items' AS text FROM conversations""")
def report_texts(spark, sf):
    c = table(spark, sf, "conversations")
    made = render.report(F.col("role"), F.lit("now"), RUN_ID, F.when(F.col("turn") % 2 == 0, "note").otherwise(""), F.col("text"), F.lit(""), F.lit("items"))
    return c.select("conv_id", "turn", made.alias("text"))


@query(f"""WITH r AS (SELECT string_agg('## Report: ' || file_name || chr(10) || chr(10) || 't' || file_name || chr(10), chr(10) ORDER BY file_name) AS t FROM (SELECT DISTINCT 'f' || (p_partkey % 90) AS file_name FROM part)),
n AS (SELECT string_agg(p_name || chr(10), chr(10) ORDER BY p_partkey) AS t FROM part WHERE p_partkey <= 50)
SELECT 'digest' AS name, '{render.INSTRUCTIONS["digest"]}' || chr(10) || '{render.LANGUAGES["en"]}' || chr(10) || chr(10) || t AS prompt FROM r
UNION ALL SELECT 'roaster-digest', '{render.INSTRUCTIONS["roaster-digest"]}' || chr(10) || '{render.LANGUAGES["en"]}' || chr(10) || chr(10) || t FROM r
UNION ALL SELECT 'new-digest', '{render.INSTRUCTIONS["new-digest"]}' || chr(10) || '{render.LANGUAGES["en"]}' || chr(10) || chr(10) || 'New coffees:' || chr(10) || t FROM n""")
def digest_prompts(spark, sf):
    part = table(spark, sf, "part")
    day = part.select(text_of("f", F.col("p_partkey") % 90).alias("file_name")).distinct().select("file_name", F.col("file_name").alias("pos"), text_of("t", F.col("file_name")).alias("text"))
    items = part.where("p_partkey <= 50").select(F.col("p_partkey").alias("pos"), text_of(F.col("p_name"), "\n").alias("entry"))
    return render.digest_jobs(day, items, "en")


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' THEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) ELSE '' END
  || '{render.FAILED_HEADING}' || chr(10) || chr(10) || 'One {render.FAILED_SUFFIX}' || chr(10) || 'Two {render.FAILED_SUFFIX}' || chr(10) AS text FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN '  ' ELSE text || chr(10) END AS t FROM conversations)""")
def failure_footers(spark, sf):
    digest = F.when(F.col("turn") % 3 == 0, "  ").otherwise(text_of(F.col("text"), "\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", render.with_failures(digest, ["One", "Two"]).alias("text"))


@query(f"""SELECT p_brand AS source, '{render.INSTRUCTIONS["batch"]}' || chr(10) || '{render.LANGUAGES["zh"]}' || chr(10) || chr(10) || 'Products:' || chr(10) || chr(10)
  || string_agg('- product_id: id ' || p_partkey || chr(10) || '  name: ' || p_name || chr(10) || '  url: u' || chr(10) || '  list price: $1' || chr(10), chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY p_brand""")
def batch_prompt_texts(spark, sf):
    blank = F.lit("")
    products = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("pos"), F.lit(0).alias("item"), text_of("id ", F.col("p_partkey")).alias("product_id"), F.col("p_name").alias("name"), F.lit("u").alias("url"), F.lit("$1").alias("list_price"), blank.alias("list_badge"), blank.alias("page_text"), blank.alias("body_html"), F.array().cast(catalog.VARIANTS).alias("variants"))
    return render.batch_prompts(products, ["source"], ["pos", "item"], "zh")


def response_rows(spark, sf) -> DataFrame:
    """Responses of text generation in the shapes and spellings that come."""
    c, turn = table(spark, sf, "conversations"), F.col("turn")
    part = lambda t: F.named_struct(F.lit("text"), t)
    usage = F.named_struct(F.lit("prompt_token_count"), F.length("text"), F.lit("totalTokenCount"), turn)
    shapes = F.when(turn % 3 == 0, F.to_json(F.struct(text_of(" ", F.col("text"), " ").alias("text"), usage.alias("usage_metadata"))))
    shapes = shapes.when(turn % 3 == 1, F.to_json(F.struct(F.array(part(F.col("text"))).alias("candidates"), usage.alias("usageMetadata"))))
    parts = F.array(F.struct(F.struct(F.array(part(F.col("text")), part(F.lit(" ")), part(F.col("role"))).alias("parts")).alias("content")))
    return c.select("conv_id", "turn", shapes.otherwise(F.to_json(F.struct(parts.alias("candidates"), usage.alias("usageMetadata")))).alias("response"))


@query("SELECT conv_id, turn, trim(text) || CASE WHEN turn % 3 = 2 THEN chr(10) || role ELSE '' END AS text, length(text)::INT AS prompt_tokens, turn AS total_tokens FROM conversations")
def response_fields(spark, sf):
    v = F.try_parse_json("response")
    usage = evaluator.usage_of(v)
    return response_rows(spark, sf).select("conv_id", "turn", evaluator.text_of(v).alias("text"), usage["prompt_token_count"].alias("prompt_tokens"), usage["total_token_count"].alias("total_tokens"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE '{"webSearchQueries":["' || role || '"],"groundingChunks":[{"web":{"uri":"u' || conv_id || '","title":""}}],"groundingSupports":[{"segment":{"startIndex":0,"endIndex":' || turn || ',"text":"' || role || '"},"groundingChunkIndices":[0,' || turn || ']}]}' END AS grounding FROM conversations""")
def response_grounding(spark, sf):
    turn, role = F.col("turn"), F.col("role")
    support = F.struct(F.struct(F.lit(0).alias("start_index"), turn.alias("endIndex"), role.alias("text")).alias("segment"), F.array(F.lit(0), turn).alias("grounding_chunk_indices"))
    meta = F.struct(F.array(role, F.lit("")).alias("web_search_queries"), F.array(F.struct(F.struct(text_of("u", F.col("conv_id")).alias("uri")).alias("web")), F.struct(F.struct(F.lit("").alias("uri")).alias("web"))).alias("groundingChunks"), F.array(support).alias("groundingSupports"))
    body = F.to_json(F.struct(F.array(F.struct(F.when(turn % 4 != 3, meta).alias("groundingMetadata"))).alias("candidates")))
    return table(spark, sf, "conversations").select("conv_id", "turn", evaluator.grounding_of(F.try_parse_json(body)).alias("grounding"))


@query("SELECT conv_id AS name, 'Report on ' || count(*) || ' products.' AS text FROM conversations GROUP BY conv_id")
def stub_answers(spark, sf):
    """What the stand-in for text generation says of each prompt, asked until there is text."""
    prompts = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("name")).agg(F.array_join(F.collect_list(F.lit("product_id: x")), "\n").alias("prompt"))
    got = evaluator.evaluated(prompts, evaluator.stub)
    return got.select(F.col("name").cast("long").alias("name"), evaluator.read(F.col("response"))["text"].alias("text"))


@query(f"""WITH e AS (SELECT event_id, '{RUN_ID}-' || event_type || '.products.' AS n, props FROM events)
SELECT n || 'raw.page' || event_id || '.json' AS file_name, props AS text FROM e UNION ALL SELECT n || 'pretty.page' || event_id || '.json', '{{' || chr(10) || '  ' || substr(props, 2, length(props) - 2) || chr(10) || '}}' FROM e""")
def json_assets(spark, sf):
    """Responses as they came and indented, a file for each."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("pos"), F.col("props").alias("body"))
    return reports.assets(events, RUN_ID, True, True)


@query("SELECT event_id, strftime(ts, '%Y%m%d') AS run_id, ts::date AS run_day, (ts::date - 6) AS window_start FROM events")
def run_days(spark, sf):
    e = table(spark, sf, "events").select("event_id", dates.run_id(F.col("ts")).alias("run_id"))
    return e.withColumn("run_day", dates.run_day(F.col("run_id"))).withColumn("window_start", dates.window_start(F.col("run_day"), 7))


@query("SELECT p_partkey, p_brand AS roaster, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'New' ELSE '' END AS badge, '    - bag | $' || p_size || ' | unavailable' AS variant FROM part")
def new_item_rows(spark, sf):
    """Products as items of a digest, and back as products."""
    one = F.array(F.struct(F.lit("bag").alias("title"), F.col("p_size").cast("string").alias("price"), F.lit(0).alias("grams"), F.lit(False).alias("available")))
    products = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("name"), F.lit("u").alias("url"), F.lit("").alias("list_price"), F.when(F.col("p_size") % 2 == 0, "New").otherwise("").alias("list_badge"), one.alias("variants"), F.lit("d").alias("description"))
    items = render.as_items(products)
    back = render.as_products(items)
    return items.join(back.select("product_id", "source"), "product_id").where("roaster = source").select(F.col("product_id").cast("long").alias("p_partkey"), "roaster", "name", "badge", F.col("variant_lines")[1].alias("variant"))
