"""Sources as a table: configuration entries as the driver reads them, and one parse for all sources as source by source."""

import json
import random
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from shelfwatch.sources import catalog, config, rules

RESPONSE = "source string, pos long, base_url string, content_type string, body string, extra int"
ODD = [None, "", " x ", "a/b.c", "7", 7, 2.9, 0, True, False, [], ["a", "", "B", 3], {}, {"k": 1, "n": None, "t": "v"}, "JSON", "html"]


def as_dict(rule):
    out = rule.asDict(recursive=True)
    return {k: tuple(v) if isinstance(v, list) else {a: tuple(b) if isinstance(b, list) else b for a, b in v.items()} if isinstance(v, dict) else v for k, v in out.items()}


def expected(entry):
    """As config.source_of reads it; an entry that it can't read is left out."""
    try:
        return config.source_of(entry)
    except (ValueError, TypeError):
        return None


def test_entries(spark):
    rnd, plain = random.Random(4), [f for f in config.Source.__dataclass_fields__ if f not in ("name", "base_url", "product_fields", "pagination")]
    entries = [3, "no", [], None, {"base_url": ""}, {"base_url": " h.example//?q#f", "enabled": "false"}, {"base_url": "https://off", "enabled": 0}, {"base_url": "https://n", "name": None}]
    for i in range(300):
        e = {"base_url": f"https://s{i}"} | ({"name": f" n{i} "} if i % 2 else {})
        for name in rnd.sample(plain, 6):
            if name != "product_url_template":
                e[name] = rnd.choice(ODD)
        if i % 3 == 0:
            e["product_fields"] = {"name_fields": rnd.choice(ODD[:4] + [["t", ""], []]), "id": rnd.choice(["q", ["z"], 5])}
            e["pagination"] = {"page_param": "p", "start": rnd.choice(["2", 3, None]), "max_pages": rnd.choice([4, "5", "x"]), "stop_on_empty": rnd.choice([0, 1, "", "false", True])}
        entries.append(e)
    got = {r.pos: as_dict(r.rule) for r in rules.from_entries(spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(entries)], "pos int, entry string")).collect()}
    want = {i: s for i, s in ((i, expected(e)) for i, e in enumerate(entries)) if s}
    assert set(got) == set(want) and len(want) > 50
    for i, s in want.items():
        w = asdict(s)
        assert got[i] == w, (entries[i], {k: (got[i][k], v) for k, v in w.items() if got[i][k] != v})


def test_file(spark, tmp_path):
    sources = [config.Source("A", "https://a", json_items_path=("x",), max_products=3), config.Source("B", "https://b")]
    (tmp_path / "s.json").write_text(json.dumps([asdict(s) for s in sources]))
    (tmp_path / "bad.json").write_text("{broken")
    for df in (rules.load(spark, f"file://{tmp_path}/s.json"), rules.of(spark, sources)):
        assert [as_dict(r.rule) for r in df.orderBy("pos").collect()] == [asdict(s) for s in sources]
    assert rules.load(spark, f"file://{tmp_path}/bad.json").count() == 0


SOURCES = [
    config.Source("feed", "https://f", exclude_tags=("Gone",), include_product_types=("Bean", ""), exclude_title_keywords=("Decaf",), max_products=4, platform="shopify"),
    config.Source("deep", "https://d", json_items_path=("a", "b"), product_fields=config.Fields(name=("label", "title"), id=("sku",)), product_url_template="/shop/{slug}?id={id}"),
    config.Source("odd", "https://o", product_url_template="/x/{other}", products_type="html"),
    config.Source("cards", "https://c", products_parser="wix_shop", exclude_title_keywords=(" Used ",), platform="wix"),
    config.Source("links", "https://l", product_link_patterns=("re:/p/\\d+$", "re:(", "/item/"), product_link_exclude_patterns=("re:9$",), exclude_title_keywords=("old stock",), max_products=3),
    config.Source("all", "https://e", product_link_patterns=()),
    config.Source("none", "https://n"),
]


def bodies(source, rnd):
    item = lambda i: rnd.choice([{"title": f"T{i}", "handle": f"h{i}", "product_type": "bean", "tags": rnd.choice(["x, gone", ["New"], None])}, {"label": f"L{i}", "sku": i, "slug": f"s{i}", "type": 1}, {"name": "Decaf", "url": f"/u/{i}?q", "product_type": " BEAN "}, "text", {"title": "", "url": "https://z/known-item", "variants": [{"price": 3, "grams": 2.5}, 4]}])
    items = [item(i) for i in range(6)]
    card = "".join(f"<a href='/product-page/c{rnd.randrange(5)}-used'>q</a><h3 data-hook='product-item-title'>{rnd.choice(['Used thing', 'Fine'])}</h3>$4.50" for _ in range(2)) + "<a href='/product-page/good'>g</a>New"
    links = "".join(f"<a href='{rnd.choice(['/p/', '/item/', '/products/', 'q/'])}{rnd.randrange(30)}{rnd.choice(['', '?x', '-old-stock'])}'>{rnd.choice(['View', 'Name ' + str(i), '', 'Old stock'])}</a>" for i in range(12))
    return [json.dumps({"products": items}), json.dumps({"a": {"b": items}, "items": items[:1]}), json.dumps(items), json.dumps(items[0]), "{broken", links, card + links, "go /product-page/raw-one now", "", None]


def test_all_sources_at_once(spark):
    rnd, rows = random.Random(2), []
    for s in [*SOURCES, config.Source("unknown", "https://u")]:
        for pos, body in enumerate(bodies(s, rnd)):
            rows.append((s.name, pos, s.base_url, rnd.choice(["application/json", "text/html", None]), body, 1))
    responses = spark.createDataFrame(rows, RESPONSE)
    got = rules.parse(responses.repartition(3), rules.of(spark, SOURCES), 200)
    names = [*catalog.NAMES, "platform"]
    want = [r for s in SOURCES for r in catalog.parse_responses(responses.where(F.col("source") == s.name).drop("source"), s, 200).withColumn("platform", F.lit(s.platform)).select(*names).collect()]
    key = lambda r: (r.source, r.pos, r.item)
    got = sorted(got.select(*names).collect(), key=key)
    want = sorted(want, key=key)
    assert {r.source for r in want} == {s.name for s in SOURCES}
    for a, b in zip(got, want, strict=False):
        assert a == b
    assert len(got) == len(want)


def test_plan_does_not_grow(spark):
    """One scan of the responses for one source as for five hundred, small rules sent to the tasks or joined by a shuffle."""
    responses = spark.createDataFrame([("s1", 0, "https://s1", "application/json", '{"products": [{"handle": "a"}]}', 1)], RESPONSE)
    size = lambda n: len(rules.parse(responses, rules.of(spark, [config.Source(f"s{i}", f"https://s{i}") for i in range(n)]))._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(1) == size(500)


def test_large_rule_tables(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_SENT", 2)
    responses = spark.createDataFrame([(f"s{i}", 0, f"https://s{i}", "application/json", '{"products": [{"handle": "a"}, {"handle": "b"}]}', 1) for i in range(5)], RESPONSE)
    got = rules.parse(responses, rules.of(spark, [config.Source(f"s{i}", "https://x", max_products=1 + i % 2) for i in range(5)]))
    assert sorted((r.source, r.name) for r in got.collect()) == sorted([(f"s{i}", "A") for i in range(5)] + [(f"s{i}", "B") for i in (1, 3)])
    assert rules.parse(responses, rules.of(spark, SOURCES)).count() == 0


@pytest.mark.parametrize("rows", [[], [(None, 0, None, None, None, None)]])
def test_nothing(spark, rows):
    assert rules.parse(spark.createDataFrame(rows, RESPONSE), rules.of(spark, SOURCES)).count() == 0
