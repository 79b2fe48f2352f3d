"""The store, re-parsing, and whole runs: recorded once, idempotent, resumable, and independent of row order."""

import json

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import classify, relational, render, reparse, seen
from shelfwatch.plans import evaluator
from shelfwatch.plans.run import Run, arguments
from shelfwatch.sources import config, reports
from shelfwatch.streaming.first_seen import upsert_stream

ROW = "hash string, url string, title string, description string, first_seen_at string, shopify_updated_at string, roaster string, platform string, pos int"


def test_upsert(spark, tmp_path):
    store = seen.SeenStore(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([("h", "u1", "t", "d", "2024-01-01", "x", "r", "", 0), ("h", "u2", "t2", "d2", "2024-01-02", "", "", "p", 1), ("g", "u", "", "", "2024-01-01", "", "", "", 2)], ROW)
    assert store.read().count() == 0 and store.upsert(one) == 1
    first = sorted(map(tuple, store.read().collect()))
    assert first[1] == ("h", "u2", "t2", "d2", "2024-01-01", "x", "r", "p")
    store.upsert(one.withColumn("first_seen_at", F.lit("2025-01-01")))
    assert sorted(map(tuple, store.read().collect())) == first and store.version() == 2


def test_upsert_in_parts_is_the_same(spark):
    rows = spark.createDataFrame([(f"h{i % 7}", f"u{i}", "t", "d", f"2024-01-{i + 1:02}", "x" if i % 3 else "", "", "p", i) for i in range(20)], ROW)
    empty = spark.createDataFrame([], seen.SCHEMA)
    whole = seen.merged(empty, rows.repartition(5))
    parts = seen.merged(seen.merged(empty, rows.where("pos < 8")), rows.where("pos >= 8"))
    assert sorted(whole.collect()) == sorted(parts.select(*whole.columns).collect())


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("h", "u", "t", "d", "2024-01-01", "", "", "", 0)], ROW)
    rows.write.parquet(f"{tmp_path}/in")
    store = seen.SeenStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        upsert_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp").awaitTermination()
    rows.withColumn("first_seen_at", F.lit("2025")).write.mode("append").parquet(f"{tmp_path}/in")
    upsert_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp").awaitTermination()
    assert [r.first_seen_at for r in store.read().collect()] == ["2024-01-01"]


def test_classify_modes(spark):
    rows = spark.createDataFrame([("a", "2024-01-30T01:00:00Z", "", "", 0), ("a", "", "", "", 1), ("b", "", "", "", 2), ("b", "", "", "", 3), ("c", "", "", "2024-02-03", 4), ("d", "", "", "", 5)], "hash string, published string, modified string, lastmod string, pos int")
    store = spark.createDataFrame([("d", "2024-01-01T00:00:00+00:00")], "hash string, first_seen_at string")
    day = F.to_date(F.lit("2024-01-30"))
    kept = {r.pos: (r.date_source, r.undated, r.is_new) for r in classify.marked(rows.repartition(3), store, day, 7, True).collect()}
    assert kept == {0: ("shopify_published_at", False, True), 1: ("seen_at", False, True), 2: ("undated", True, True), 3: ("seen_at", False, True), 4: ("wix_lastmod", False, False), 5: ("seen_at", False, False)}
    read = {r.pos: (r.undated, r.is_new, r.outside) for r in classify.marked(rows, store, day, 7, False).collect()}
    assert read == {0: (False, True, False), 1: (True, False, True), 2: (True, False, True), 3: (True, False, True), 4: (False, False, True), 5: (False, False, True)}


REPORT = f"""# R

Roaster: Shop
## Recommendations
- not an item
{render.LIST_HEADING}

- product_id: p1
  name: A: b
  url: http://x/a
  list price: $3
  variants:
    - bag | 250g
    -
    - box
  description:
  First line
  second line is lost

- Old Thing (http://x/old)
  name: ignored
- Plain
-
- product_id:
  url: http://x/c
  description: inline text
  badge: New
## Next
- product_id: late
"""


def test_reparse(spark):
    df = spark.createDataFrame([("f.md", REPORT), ("empty.md", "none"), ("g.md", f"{render.LIST_HEADING}\n- product_id: q")], "file_name string, text string")
    got = {(r.file_name, r.name or r.url or r.product_id): r for r in reparse.items(df.repartition(3)).collect()}
    assert set(got) == {("f.md", "A: b"), ("f.md", "Old Thing"), ("f.md", "Plain"), ("f.md", "http://x/c"), ("g.md", "q")}
    a, c = got["f.md", "A: b"], got["f.md", "http://x/c"]
    assert (a.roaster, a.product_id, a.list_price, a.description, a.variant_lines) == ("Shop", "p1", "$3", "First line", ["  variants:", "    - bag | 250g", "    - box"])
    assert (c.description, c.badge, len(c.product_id)) == ("inline text", "New", 64)
    assert got["f.md", "Old Thing"].url == "http://x/old" and got["g.md", "q"].roaster == "g.md"


def test_failed_names(spark):
    texts = [f"Roaster: A\n{render.FAILED_SENTINEL}\nB {render.FAILED_SUFFIX}", f"Roaster: C\nfine, no {render.FAILED_SUFFIX} here", f"Roaster: D\n {render.FAILED_SUFFIX}\nA {render.FAILED_SUFFIX}"]
    df = spark.createDataFrame([(f"f{i}", t, i) for i, t in enumerate(texts)], "file_name string, text string, pos int")
    assert [r.name for r in reparse.failed_names(df).orderBy("pos").collect()] == ["A", "B", "D"]
    assert [r.failed for r in df.orderBy("pos").select(reparse.is_failed(F.col("text")).alias("failed")).collect()] == [True, False, True]
    a = spark.createDataFrame([(0, " x "), (1, ""), (2, "y")], "pos int, name string")
    assert [r.name for r in relational.ordered_union(a, spark.createDataFrame([(0, "z"), (1, "x")], "pos int, name string")).orderBy("grp", "pos").collect()] == ["x", "y", "z"]


def test_evaluator(spark):
    r = {"candidates": [{"content": {"parts": [{"text": " a "}, {"text": ""}, {"text": "b"}]}, "groundingMetadata": {"webSearchQueries": ["q"], "groundingChunks": [{"web": {"uri": "u"}}, {}], "groundingSupports": [{"segment": {"startIndex": 0, "text": "t"}, "groundingChunkIndices": [0, "x"]}, {}]}}], "usageMetadata": {"promptTokenCount": 3}}
    v = F.try_parse_json("r")
    got = spark.createDataFrame([(json.dumps(r), '{"totalTokens": 9}')], "r string, n string").select(evaluator.text_of(v).alias("text"), evaluator.usage_of(v).alias("usage"), evaluator.grounding_of(v).alias("grounding"), evaluator.total_tokens_of(F.try_parse_json("n")).alias("n"), evaluator.read(F.col("r")).alias("both")).first()
    assert got.text == "a\nb" and got.usage.prompt_token_count == 3 and got.usage.total_token_count is None and got.n == 9
    grounding = {"webSearchQueries": ["q"], "groundingChunks": [{"web": {"uri": "u", "title": ""}}], "groundingSupports": [{"segment": {"startIndex": 0, "text": "t"}, "groundingChunkIndices": [0]}]}
    assert json.loads(got.grounding) == grounding
    assert got.both.grounding == f"## Grounding metadata\n\n```json\n{json.dumps(grounding, indent=2)}\n```\n"
    odd = [None, "no json", "[]", "{}", '{"text": " top ", "candidates": 3}', '{"candidates": [{"text": " c "}]}', '{"candidates": [{"content": {"parts": "x"}}]}']
    read = spark.createDataFrame([(x,) for x in odd], "r string").select(evaluator.read(F.col("r")).alias("x")).collect()
    assert [(x.x.text, x.x.grounding) for x in read] == [("", ""), ("", ""), ("", ""), ("", ""), ("top", ""), ("c", ""), ("", "")]
    got = evaluator.evaluated(spark.createDataFrame([("n", "p")], "name string, prompt string"), evaluator.stub).select(evaluator.read(F.col("response")).alias("x")).first().x
    assert got.text == "Report on 0 products."


def test_generation_waits_and_tries_again(spark):
    import time

    class Service:
        def generate(self, model, prompt, temperature, search):
            time.sleep(0.5 if "slow" in prompt else 0)
            return json.dumps({"text": f"{model} {search}"})

        def count_tokens(self, model, prompt):
            return len(prompt)

    ask = evaluator.Generation(Service, "m", 0.1, count=True)
    assert evaluator.asked(ask, "quick", 1) == '{"text": "m True"}' and evaluator.asked(ask, "slow", 2) is None
    answers = iter([None, "{", '{"candidates": [{"groundingMetadata": {"text": "aside"}}]}', '{"candidates": [{"content": {"parts": [{"text": "x"}]}}]}'])
    assert "parts" in evaluator.asked(lambda _: next(answers), "", 10)
    assert evaluator.asked(lambda _: "{}", "", 2) == "{}"


@pytest.fixture
def few_tasks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_whole_runs(spark, tmp_path, few_tasks):
    feed = lambda *hs: json.dumps({"products": [{"id": i, "title": h, "handle": h, "body_html": f"<p>about {h}</p>", "published_at": "2024-01-29T00:00:00Z" if i % 2 else ""} for i, h in enumerate(hs)]})
    responses = spark.createDataFrame([("One", 1, "", "https://one", "application/json", feed("a", "b", "c")), ("Two", 1, "", "https://two", "text/html", "<a href='/products/x'>X</a>")], "source string, pos long, url string, base_url string, content_type string, body string")
    pages = spark.createDataFrame([("https://two/products/x", "<p>Page of x</p>", "Mon, 29 Jan 2024 00:00:00 GMT")], "url string, html string, modified string")
    lastmods = spark.createDataFrame([], "url string, lastmod string, pos int")
    sources = [config.Source("One", "https://one", platform="shopify"), config.Source("Two", "https://two", platform="wix"), config.Source("Gone", "https://gone")]
    s = config.Settings(reports_dir=str(tmp_path / "reports"), language="en")
    (tmp_path / "reports").mkdir()
    store = seen.SeenStore(spark, f"file://{tmp_path}/store")
    run = Run(spark, s, sources, "20240130", store)
    run.full(responses, pages, lastmods)
    names = {p.name for p in (tmp_path / "reports").glob("*.md")}
    assert names == {"20240130-one.md", "20240130-two.md", "20240130-z-digest.md", "20240130-z-roaster-digest.md", "20240130-z-new-digest.md"}
    assert f"Gone {render.FAILED_SUFFIX}" in (tmp_path / "reports/20240130-z-digest.md").read_text()
    assert "Page of x" in (tmp_path / "reports/20240130-two.md").read_text()
    before = sorted(store.read().collect())
    assert len(before) == 4 and {r.first_seen_at[:10] for r in before} == {"2024-01-30"}
    text = (tmp_path / "reports/20240130-one.md").read_text()
    run.full(responses, pages, lastmods)
    assert sorted(store.read().collect()) == before and (tmp_path / "reports/20240130-one.md").read_text() == text
    (tmp_path / "reports/20240130-two.md").write_text(f"Roaster: Two\n{render.FAILED_SENTINEL}")
    run.resume(responses, pages, lastmods)
    assert "Page of x" in (tmp_path / "reports/20240130-two.md").read_text()
    assert run.digest_only() == 0
    assert Run(spark, s, sources, "20240131", store).digest_only() == 1


def test_live_run(spark, tmp_path, few_tasks):
    from shelfwatch.plans import logs
    from shelfwatch.sources import fetch

    feed = json.dumps({"products": [{"id": 1, "title": "A", "handle": "a", "body_html": "<p>about a</p>"}]})
    site = {
        "https://one/products.json": (200, feed, {"content-type": "application/json"}),
        "https://two/products.json": (200, "<a href='/products/x'>X</a><a href='/products/y'>Y</a>", {"content-type": "text/html"}),
        "https://two/products/x": (200, "<p>Page of x. Related goods</p>", {"last-modified": "Mon, 29 Jan 2024 00:00:00 GMT"}),
        "https://two/robots.txt": (200, "User-agent: *\nDisallow: /products/y", {}),
        "https://two/store-products-sitemap.xml": (200, "<urlset><url><loc>https://two/products/y</loc><lastmod>2024-01-28</lastmod></url></urlset>", {}),
        "https://bad/products.json": (200, "{broken", {"content-type": "application/json"}),
    }

    def transport():
        return lambda url, headers: fetch.Response(*site.get(url, (404, "", {}))) if "User-Agent" not in headers else None

    sources = [config.Source("One", "https://one", platform="shopify", products_headers={"User-Agent": "own"}), config.Source("Two", "https://two", platform="wix", page_text_stop_phrases=("related",)), config.Source("Bad", "https://bad"), config.Source("Denied", "https://denied")]
    (tmp_path / "r").mkdir()
    s = config.Settings(reports_dir=str(tmp_path / "r"), language="en", jitter_max_s=0.0, jitter_min_s=0.0, save_prompt=True, save_raw_products_json=True, save_pretty_products_json=True, log_path=str(tmp_path / "logs/run.log"), log_json_max_chars=3)
    logs.logger(s)
    deny = spark.createDataFrame([("denied",)], "domain string")
    store = seen.SeenStore(spark, f"file://{tmp_path}/store")
    Run(spark, s, sources, "20240130", store, deny=deny).live(transport)
    files = {p.name: p.read_text() for p in (tmp_path / "r").iterdir()}
    assert {"20240130-one.md", "20240130-two.md", "20240130-one.prompt.txt", "20240130-z-digest.prompt.txt", "20240130-one.products.raw.page1.json", "20240130-one.products.pretty.page1.json"} <= set(files)
    assert files["20240130-one.products.raw.page1.json"] == feed and files["20240130-one.products.pretty.page1.json"] == json.dumps(json.loads(feed), indent=2)
    assert "Page of x." in files["20240130-two.md"] and "Related" not in files["20240130-two.md"] and "20240130-bad.md" not in files
    assert f"Bad {render.FAILED_SUFFIX}" in files["20240130-z-digest.md"] and "Denied" not in files["20240130-z-digest.md"]
    log = (tmp_path / "logs/run.log").read_text()
    assert "Denied is denied" in log and "Bad, page 1 is no JSON: {br..." in log
    assert "'wix_lastmod': 1" in log and "'http_last_modified': 1" in log


def test_one_source_fails_alone(spark, tmp_path, few_tasks, monkeypatch):
    from shelfwatch.plans import run as plan

    parse = plan.rules.parse

    def broken(responses, asked, limit):
        return parse(responses, asked, limit).withColumn("name", F.when(F.col("source") == "Bad", F.raise_error(F.lit("odd feed")).cast("string")).otherwise(F.col("name")))

    monkeypatch.setattr(plan.rules, "parse", broken)
    feed = json.dumps({"products": [{"id": 1, "title": "A", "handle": "a"}]})
    responses = spark.createDataFrame([(n, 1, f"https://{n}", "application/json", feed) for n in ("Good", "Bad")], "source string, pos long, base_url string, content_type string, body string")
    (tmp_path / "r").mkdir()
    sources = [config.Source("Bad", "https://bad"), config.Source("Good", "https://good")]
    run = Run(spark, config.Settings(reports_dir=str(tmp_path / "r"), language="en"), sources, "20240130", seen.SeenStore(spark, f"file://{tmp_path}/store"))
    run.full(responses, spark.createDataFrame([], "url string, html string, modified string"), spark.createDataFrame([], "url string, lastmod string, pos int"))
    assert {p.name for p in (tmp_path / "r").glob("*.md")} >= {"20240130-good.md", "20240130-z-digest.md"}
    assert f"Bad {render.FAILED_SUFFIX}" in (tmp_path / "r/20240130-z-digest.md").read_text()


def files_of(tmp_path):
    return {str(p.relative_to(tmp_path)) for p in (tmp_path / "store/data").rglob("*.parquet")}


def test_store_in_buckets(spark, tmp_path):
    """An upsert adds to its keys' buckets and leaves all other files; parts become one; old versions go; rows as merged() gives them."""
    store, whole = seen.SeenStore(spark, f"file://{tmp_path}/store", buckets=8), spark.createDataFrame([], seen.SCHEMA)
    every = [(f"h{i}", f"u{i}", "t", "d", "2024-01-01", "x" if i % 2 else "", "", "p", i) for i in range(60)]
    batches = [every] + [[(f"h{i % 7}", f"v{i}", "t2", "", f"2024-02-{i + 1:02}", "", f"r{i}" if i % 3 else "", "", i)] for i in range(12)]
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, ROW)
        before, touched = files_of(tmp_path), {r.b for r in batch.select(store.bucket(8).alias("b")).collect()}
        store.upsert(batch)
        new = files_of(tmp_path) - before
        assert {int(n.partition("bucket=")[2].partition("/")[0]) for n in new} <= touched if k else len(touched) == 8
        whole = spark.createDataFrame(seen.merged(whole, batch).collect(), seen.merged(whole, batch).schema)
        assert max(map(len, store.manifest(store.version())["parts"].values())) <= seen.MOST_PARTS
    assert sorted(map(tuple, store.read().select(*sorted(whole.columns)).collect())) == sorted(map(tuple, whole.select(*sorted(whole.columns)).collect()))
    assert len(list((tmp_path / "store/manifests").glob("*.json"))) == seen.KEPT
    assert store.read(buckets=[3]).count() == whole.where(store.bucket(8) == 3).count()
    assert store.upsert(spark.createDataFrame([], ROW)) == store.version()


def test_store_versions_and_writers(spark, tmp_path, monkeypatch):
    one, two = (seen.SeenStore(spark, f"file://{tmp_path}/store", buckets=2) for _ in range(2))
    row = lambda h, u: spark.createDataFrame([(h, u, "", "", "2024-01-01", "", "", "", 0)], ROW)
    first = one.upsert(row("a", "u1"))
    commit = one._commit

    def late(version, manifest):
        monkeypatch.undo()
        two.upsert(row("b", "u2"))  # between the part and the manifest
        commit(version, manifest)

    monkeypatch.setattr(one, "_commit", late)
    assert one.upsert(row("a", "u3")) == 3
    assert sorted((r.hash, r.url) for r in one.read().collect()) == [("a", "u3"), ("b", "u2")]
    assert [r.url for r in one.read(first).collect()] == ["u1"]
    with pytest.raises(seen.Conflict):
        one._commit(3, {})
    broken = row("c", "u4").withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        one.upsert(broken)
    assert one.version() == 3 and one.read().count() == 2


def test_store_of_snapshots(spark, tmp_path):
    """A store of the earlier layout, without its later columns, is read and taken over."""
    spark.createDataFrame([("h", "u", "t", "d", "2023-01-01")], "hash string, url string, title string, description string, first_seen_at string").write.parquet(f"file://{tmp_path}/store/v=3")
    store = seen.SeenStore(spark, f"file://{tmp_path}/store")
    assert [tuple(r) for r in store.read().collect()] == [("h", "u", "t", "d", "2023-01-01", "", "", "")]
    store.upsert(spark.createDataFrame([("h", "u2", "t", "d", "2024-01-01", "", "r", "", 0), ("i", "", "", "", "2024-01-02", "", "", "", 1)], ROW))
    assert sorted((r.hash, r.url, r.first_seen_at, r.roaster) for r in store.read().collect()) == [("h", "u2", "2023-01-01", "r"), ("i", "", "2024-01-02", "")]


def test_arguments():
    a = arguments(["--resume", "--no-save-report", "--http-concurrency", "3", "--run-id", "20240101"])
    assert (a.resume, a.save_report, a.http_concurrency, a.model, a.run_id) == (True, False, 3, None, "20240101")


def test_report_files(spark, tmp_path):
    for name, text in {"20240101-a.md": " x ", "20240101-b.md": " \n", "20240101-z-digest.md": "d", "20240102-a.md": "y"}.items():
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in reports.scan(spark, f"file://{tmp_path}", "20240101").collect()] == [("20240101-a.md", "x")]
