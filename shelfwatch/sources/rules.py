"""Source configurations as a table, and the parse of all sources' responses by it.

A source is a row: its entry in the configuration, read as the driver reads it, in batches. Responses meet their source's row by a join, and what a source says (paths, field
names, patterns, tags, keywords, limits) is applied as data, so one scan and one plan serve any number of sources.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.functions import text, urls
from shelfwatch.operators.relational import first_wins, nth_below
from shelfwatch.sources import catalog, config
from shelfwatch.sources.catalog import as_text, at, items_of, kind_of, tags_of, truthy_text, variants_of
from shelfwatch.sources.config import Source

#: Rules of at most so many sources go to every task; larger tables are joined by a shuffle.
MOST_SENT = 20_000
NO_MATCH = "(?!)"


# The fields of config.Source.
RULE = """name string, base_url string, platform string, products_path string, enabled boolean, products_type string, products_parser string, jitter_multiplier double,
products_headers map<string,string>, products_params map<string,string>, product_page_headers map<string,string>, product_link_patterns array<string>, product_link_exclude_patterns array<string>,
product_url_template string, json_items_path array<string>, product_fields struct<name:array<string>,url:array<string>,handle:array<string>,id:array<string>>,
pagination struct<page_param:string,start:int,max_pages:int,page_size_param:string,page_size:int,stop_on_empty:boolean>, max_products int, page_text_stop_phrases array<string>,
include_tags array<string>, exclude_tags array<string>, include_product_types array<string>, exclude_product_types array<string>, exclude_title_keywords array<string>"""


@F.pandas_udf(T.StringType())
def normalized(entries: pd.Series) -> pd.Series:
    """Entries as config.source_of reads them, all fields spelled out; null for one that gives no source or can't be read."""

    def one(entry: str | None) -> str | None:
        try:
            source = config.source_of(json.loads(entry or "null"))
        except (ValueError, TypeError):
            return None
        return source and json.dumps(asdict(source))

    return entries.map(one)


def from_entries(entries: DataFrame) -> DataFrame:
    """(pos, rule) of configuration entries (pos, entry: the JSON of one source): a Source's fields in a struct.

    Entries that are no object, have no base URL or aren't enabled are left out, as are those with a value that can't be
    read, each by itself; unnamed ones are called by their URL.
    """
    return entries.select("pos", F.from_json(normalized("entry"), RULE).alias("rule")).where("rule.name is not null")


def of(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(pos, rule) of sources that were read on the driver."""
    rows = spark.createDataFrame([(i, json.dumps(asdict(s))) for i, s in enumerate(sources)], "pos int, entry string")
    return rows.select("pos", F.from_json("entry", RULE).alias("rule"))


def load(spark: SparkSession, file: str) -> DataFrame:
    """(pos, rule) of a configuration file: a JSON array of entries; none if it is something else."""
    whole_file = spark.read.option("wholetext", True).text(file)
    many = F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")
    return from_entries(whole_file.select(F.posexplode(many).alias("pos", "v")).select("pos", F.to_json("v").alias("entry")))


def lowered(xs: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(xs, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def patterns(xs: Column) -> Column:
    """URL patterns as (regex, text): re: marks a regular expression, an invalid one matches nothing."""
    valid = lambda x: F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), x)
    own = lambda x: F.substring(x, 4, 2**31 - 1)
    return F.transform(xs, lambda x: F.struct(x.startswith("re:").alias("regex"), F.when(x.startswith("re:"), F.coalesce(valid(own(x)), F.lit(NO_MATCH))).otherwise(x).alias("text")))


def prepared(rules: DataFrame) -> DataFrame:
    """(source, rule): what the parse asks of a source, put in the form that it is asked for once for each source."""
    r = lambda name: F.col("rule")[name]
    keys = lambda xs: F.transform(xs, lambda k: F.concat(F.lit("$['"), k, F.lit("']")))
    f = r("product_fields")
    return rules.select(
        r("name").alias("source"),
        F.struct(
            r("platform").alias("platform"),
            r("products_type").alias("products_type"),
            r("products_parser").alias("products_parser"),
            F.concat(F.lit("$"), F.array_join(F.transform(r("json_items_path"), lambda k: F.concat(F.lit("['"), k, F.lit("']"))), "")).alias("items"),
            *(keys(f[k]).alias(f"{k}_keys") for k in ("name", "url", "handle", "id")),
            r("product_url_template").alias("template"),
            patterns(r("product_link_patterns")).alias("patterns"),
            patterns(r("product_link_exclude_patterns")).alias("not_patterns"),
            *(lowered(r(k)).alias(k) for k in ("include_tags", "exclude_tags", "include_product_types", "exclude_product_types")),
            lowered(r("exclude_title_keywords")).alias("words"),
            F.filter(F.transform(r("exclude_title_keywords"), F.lower), lambda x: x != "").alias("title_words"),
            r("max_products").alias("max_products"),
        ).alias("rule"),
    )


def first_of(v: Column, keys: Column) -> Column:
    """The first value under one of the keys that isn't blank, as text."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(keys, lambda k: as_text(F.try_variant_get(v, k, "variant"))), lambda x: x != ""), F.lit(1)), F.lit(""))


def found_at(doc: Column, place: Column) -> Column:
    """A document's items: the list at a source's own place where it isn't empty, else as for any source."""
    own = F.try_variant_get(doc, place, "array<variant>")
    return F.coalesce(F.when(place.isNotNull() & (F.size(own) > 0), own), items_of(doc, None))


def hits(words_: Column, name: Column, url: Column) -> Column:
    """Is a keyword part of the name or URL, or, its blanks as hyphens, of the URL?"""
    return F.exists(words_, lambda k: F.contains(F.lower(name), k) | F.contains(F.lower(url), k) | F.contains(F.lower(url), F.replace(k, F.lit(" "), F.lit("-"))))


def matched(url: Column, ps: Column) -> Column:
    return F.exists(ps, lambda p: F.when(p["regex"], F.call_function("rlike", url, p["text"])).otherwise(F.contains(url, p["text"])))


def resolved(base_url: Column, url: Column, handle: Column, item_id: Column, template: Column) -> Column:
    """As urls.resolved, the template a column; one with other fields than {handle}, {id} and {slug} makes none."""
    made = F.replace(F.replace(F.replace(template, F.lit("{handle}"), handle), F.lit("{id}"), item_id), F.lit("{slug}"), handle)
    made = F.when(template.isNull() | template.rlike(r"\{(?!(handle|id|slug)\})"), "").otherwise(made)
    u = F.when((url == "") & ((handle != "") | (item_id != "")), made).otherwise(url)
    u = F.when((u == "") & (handle != ""), F.concat(F.lit("/products/"), handle)).otherwise(u)
    return urls.canonical(F.when(u.startswith("/"), urls.joined(base_url, u)).otherwise(u))


def cards_of(body: Column, base_url: Column, links: Column, words_: Column) -> Column:
    """Cards of a shop page: (href, name, price, badge), without those that a keyword excludes."""
    hrefs = F.transform(F.filter(links, lambda x: F.contains(x["href"], F.lit(catalog.CARD_LINK))), lambda x: x["href"])
    hrefs = F.when(F.size(hrefs) > 0, hrefs).otherwise(F.regexp_extract_all(body, F.lit(r"""(/product-page/[^"'<>\s?#]+)"""), F.lit(1)))

    # A step at a time: what one reads several times isn't an expression but a field of the one before.
    at_url = F.transform(hrefs, lambda h: F.struct(urls.canonical(urls.joined(base_url, h)).alias("href")))
    seen = F.transform(at_url, lambda c: F.struct(c["href"].alias("href"), catalog.around_card(body, c["href"]).alias("around")))
    hooks = F.transform(seen, lambda c: F.struct(c["href"].alias("href"), c["around"].alias("around"), *(catalog.card_hook(c["around"], n).alias(n) for n in ("title", "badge"))))
    shown = F.transform(hooks, lambda c: F.struct(c["href"].alias("href"), F.coalesce(F.nullif(c["title"], F.lit("")), urls.name_from(c["href"])).alias("name"), catalog.card_price(c["around"]).alias("price"), F.coalesce(F.nullif(c["badge"], F.lit("")), catalog.card_badge(c["around"])).alias("badge")))
    return F.filter(shown, lambda c: ~hits(words_, c["name"], c["href"]))


#: Parsers of pages by the name that a source gives: (body, base URL, links, keywords) to cards.
PARSERS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {"wix_shop": cards_of}
ENTRY = "struct<v:variant,href:string,name:string,price:string,badge:string>"


def entries_of(rows: DataFrame) -> DataFrame:
    """rows with `kind`, json, card or link, and `entries`: what each response holds, in order."""
    r, body, base = F.col("rule"), F.col("body"), F.col("base_url")
    says = (r["products_type"] == "json") | ((r["products_type"] == "auto") & F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("json")))
    rows = rows.withColumn("_doc", F.when(says, F.try_parse_json("body")))
    rows = rows.withColumn("_links", catalog.exact_links(F.when(F.col("_doc").isNull(), body)))
    cards = F.lit(None)
    for name, parser in PARSERS.items():
        cards = F.when(F.col("_doc").isNull() & (r["products_parser"] == name), parser(body, base, F.col("_links"), r["words"])).otherwise(cards)
    rows = rows.withColumn("_cards", cards)
    none = F.lit(None).cast("string")
    items = F.transform(found_at(F.col("_doc"), r["items"]), lambda v: F.struct(v.alias("v"), none.alias("href"), none.alias("name"), none.alias("price"), none.alias("badge")))
    shown = F.transform("_cards", lambda c: F.struct(F.lit(None).cast("variant").alias("v"), c["href"].alias("href"), c["name"].alias("name"), c["price"].alias("price"), c["badge"].alias("badge")))
    listed = F.transform("_links", lambda x: F.struct(F.lit(None).cast("variant").alias("v"), x["href"].alias("href"), x["text"].alias("name"), F.lit("").alias("price"), F.lit("").alias("badge")))
    kind = F.when(F.col("_doc").isNotNull(), "json").when(F.size("_cards") > 0, "card").otherwise("link")
    return rows.withColumn("kind", kind).withColumn("entries", F.when(F.col("kind") == "json", items).when(F.col("kind") == "card", shown).otherwise(listed)).drop("_doc", "_links", "_cards")


def json_fields(v: Column, r: Column) -> Column:
    """What a JSON item says of itself."""
    title = F.coalesce(F.nullif(as_text(at(v, "title")), F.lit("")), as_text(at(v, "name")))
    own = [first_of(v, r[f"{k}_keys"]).alias(k) for k in ("name", "url", "handle", "id")]
    return F.struct(*own, F.lower(title).alias("title"), F.lower(as_text(at(v, "product_type"))).alias("product_type"), tags_of(v).alias("tags"), *(truthy_text(at(v, k)).alias(k) for k in ("body_html", "updated_at", "published_at")), variants_of(v).alias("variants"))


def allowed(p: Column, r: Column) -> Column:
    """Do the source's tags, types and keywords let an item's fields pass?"""
    free = lambda xs: F.size(xs) == 0
    ok = (free(r["include_tags"]) | F.arrays_overlap(p["tags"], r["include_tags"])) & ~F.arrays_overlap(p["tags"], r["exclude_tags"])
    ok = ok & (free(r["include_product_types"]) | F.array_contains(r["include_product_types"], p["product_type"])) & ~F.array_contains(r["exclude_product_types"], p["product_type"])
    return ok & ~F.exists(r["title_words"], lambda k: F.contains(p["title"], k))


def parse(responses: DataFrame, rules: DataFrame, limit: int = 200) -> DataFrame:
    """Products of captured responses (source, pos, base_url, content_type, body) by their sources' rules, with platform.

    The same rows as catalog.parse_responses gives source by source; responses of a source without a rule give none. The
    largest limit of all sources bounds what a source's rows are before they are brought together and ranked.
    """
    asked = prepared(rules)
    own_limit = F.greatest(F.lit(1), F.coalesce(F.nullif(F.col("rule.max_products"), F.lit(0)), F.lit(limit)))
    held = asked.agg(F.count(F.lit(1)).alias("n"), F.max(own_limit).alias("most")).head()
    few, most = held.n <= MOST_SENT, held.most or limit
    rows = entries_of(responses.select("source", "pos", "base_url", "content_type", "body").join(F.broadcast(asked) if few else asked, "source"))
    rows = rows.select("source", F.col("pos").cast("long").alias("pos"), "base_url", "kind", "rule", F.posexplode("entries").alias("item", "e"))
    is_json, r = F.col("kind") == "json", F.col("rule")
    rows = rows.where(~is_json | (kind_of(F.col("e.v")) == "OBJECT")).withColumn("p", F.when(is_json, json_fields(F.col("e.v"), r)))
    full = F.when(F.col("kind") == "link", urls.joined(F.col("base_url"), F.col("e.href"))).otherwise(F.col("e.href"))
    rows = rows.withColumn("full", F.when(~is_json, full))
    chosen = ((F.size(r["patterns"]) == 0) | matched(F.col("full"), r["patterns"])) & ~matched(F.col("full"), r["not_patterns"])
    rows = rows.where(F.when(is_json, allowed(F.col("p"), r)).when(F.col("kind") == "link", chosen).otherwise(True))
    made = resolved(F.col("base_url"), F.col("p.url"), F.col("p.handle"), F.col("p.id"), r["template"])
    rows = rows.withColumn("url", F.when(is_json, made).otherwise(urls.canonical(F.col("full"))))
    # The window is a fence, too: conditions on names and URLs would else be moved below and spelled out time and again.
    rows = first_wins(rows.withColumn("once", F.when(is_json, F.col("item").cast("string")).otherwise(F.col("url"))), ["source", "pos", "once"], ["item"])
    shown = text.collapse(F.col("e.name"))
    generic = (shown == "") | F.lower(shown).isin(*catalog.GENERIC_LINKS) | F.contains(F.lower(shown), F.lit("quick view"))
    bare = F.when(is_json, F.col("p.name") == "").when(F.col("kind") == "link", generic).otherwise(False)
    named = F.when(bare, urls.name_from(F.col("url"))).when(is_json, F.col("p.name")).when(F.col("kind") == "link", shown).otherwise(F.col("e.name"))
    blank = F.lit("")
    rows = rows.where(F.col("url") != "").withColumn("name", named)
    products = rows.select(
        "source",
        "pos",
        "item",
        F.when(is_json, urls.product_id(F.col("source"), F.col("p.id"), F.col("url"))).otherwise(urls.id_of(F.col("url"))).alias("product_id"),
        "name",
        "url",
        F.coalesce("e.price", blank).alias("list_price"),
        F.coalesce("e.badge", blank).alias("list_badge"),
        F.coalesce("p.body_html", blank).alias("body_html"),
        F.coalesce("p.variants", F.array().cast(catalog.VARIANTS)).alias("variants"),
        F.coalesce("p.updated_at", blank).alias("shopify_updated_at"),
        F.coalesce("p.published_at", blank).alias("shopify_published_at"),
        F.col("rule.platform").alias("platform"),
        own_limit.alias("_most"),
        ((F.col("kind") == "link") & hits(r["words"], F.col("name"), F.col("url"))).alias("_out"),
    )
    return nth_below(products.where("not _out").drop("_out"), ["source"], ["pos", "item"], most, F.col("_most")).drop("_most")
