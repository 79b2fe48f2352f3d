"""Ordered rendering: item lists, prompts, digests, failure footers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import text
from shelfwatch.operators.relational import listed

# The marks by which reports are parsed again, and the lengths fields are cut to.
LIST_HEADING = "## Coffee list"
FAILED_SUFFIX = "roaster report generation has failed"
FAILED_SENTINEL = "Gemini returned no text for this roaster."
FAILED_HEADING = "## Report Generation Failures"
CAPS = {"product_id": 200, "name": 200, "url": 400, "list_price": 40, "list_badge": 40}

INSTRUCTIONS = {
    "batch": "Below are the products of one catalog. Recommend the few that stand out, say why, and name the evidence; it is fine to recommend none.",
    "digest": "Below are reports on several catalogs. Summarise their main recommendations, name every catalog, and add nothing of your own.",
    "new-digest": "Below are the products that are new in the last 7 days. Summarise the best of them, and add nothing of your own.",
    "roaster-digest": "Below are reports on several catalogs. Rate each from 1 to 10 by its strongest products, and explain the highest and lowest ratings.",
}
LANGUAGES = {"zh": "Use 简体中文 for the entire report.", "en": "Use English for the entire report."}


def capped(products: DataFrame) -> DataFrame:
    return products.withColumns({c: text.field(F.coalesce(c, F.lit("")), n) for c, n in CAPS.items()})


def description_of(page_text: Column, body_html: Column, chars: int = 0) -> Column:
    body = F.when(body_html != "", text.field(text.sanitized(body_html, chars, False), chars)).otherwise("")
    return F.coalesce(F.nullif(text.field(page_text, chars), F.lit("")), body)


def entry(first: Sequence[tuple[str, Column]], price: Column, badge: Column, variants: Column, description: Column) -> Column:
    """An item as lines, with a blank one at the end; price, badge, variants and description only if there are any."""
    head = [F.concat(F.lit(f"{'- ' if i == 0 else '  '}{label}: "), c) for i, (label, c) in enumerate(first)]
    more = [F.when(price != "", F.concat(F.lit("  list price: "), price)), F.when(badge != "", F.concat(F.lit("  badge: "), badge))]
    described = F.when(description != "", F.concat(F.lit("  description:\n  "), description))
    lines = F.when(F.size(variants) > 0, F.array_join(variants, "\n"))
    return F.concat(F.concat_ws("\n", *head, *more, lines, described), F.lit("\n"))


def product_entry(products: DataFrame, chars: int = 0) -> DataFrame:
    """products (with page_text) and their entry."""
    p = capped(products)
    about = description_of(F.coalesce("page_text", F.lit("")), F.coalesce("body_html", F.lit("")), chars)
    return p.withColumn("entry", entry([(c, F.col(c)) for c in ("product_id", "name", "url")], F.col("list_price"), F.col("list_badge"), text.variant_lines(F.col("variants")), about))


def item_list(products: DataFrame, keys: list[str], order: list[str], chars: int = 0) -> DataFrame:
    """The item list of each key, as it stands in reports."""
    body = listed(product_entry(products, chars), keys, F.col("entry"), order, "\n")
    return body.withColumn("text", F.concat(F.lit(LIST_HEADING + "\n\n"), F.col("text"), F.lit("\n")))


def batch_prompts(products: DataFrame, keys: list[str], order: list[str], language: str, chars: int = 0) -> DataFrame:
    body = listed(product_entry(products, chars), keys, F.col("entry"), order, "\n")
    return body.withColumn("text", F.concat(F.lit(f"{INSTRUCTIONS['batch']}\n{LANGUAGES[language]}\n\nProducts:\n\n"), F.col("text")))


def as_items(products: DataFrame) -> DataFrame:
    """Products (with description) as the items of reports and digests."""
    return products.select(F.col("source").alias("roaster"), "product_id", "name", "url", "list_price", F.col("list_badge").alias("badge"), "description", text.variant_lines(F.col("variants")).alias("variant_lines"))


def as_products(items: DataFrame) -> DataFrame:
    """Items of reports as products to classify; what reports don't tell is blank."""
    blank = [F.lit("").alias(c) for c in ("body_html", "shopify_updated_at", "shopify_published_at")]
    return items.select(F.col("roaster").alias("source"), "product_id", "name", "url", "list_price", F.col("badge").alias("list_badge"), "description", *blank)


def report(name: Column, generated: Column, run_id: str, note: Column, body: Column, grounding: Column, items: Column, title: str = "Catalog Report") -> Column:
    head = F.concat(F.lit(f"# {title}\n\nRoaster: "), name, F.lit("\nGenerated: "), generated, F.lit(f"\nRun: {run_id}\n\n## Recommendations\n\n"))
    return F.concat(head, F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in (note, body, grounding, items))))


def digest_jobs(reports: DataFrame, items: DataFrame, language: str, with_new: bool = True) -> DataFrame:
    """(name, prompt): two jobs if there are reports, one more if there are new items. reports: (pos, file_name, text); items: (pos, entry)."""
    shown = F.concat(F.lit("## Report: "), F.col("file_name"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    tail = f"\n{LANGUAGES[language]}\n\n"
    whole = listed(reports.withColumn("k", F.lit(1)), ["k"], shown, ["pos"], "\n")
    out = None
    for name in ("digest", "roaster-digest"):
        job = whole.select(F.lit(name).alias("name"), F.concat(F.lit(INSTRUCTIONS[name] + tail), F.col("text")).alias("prompt"))
        out = job if out is None else out.unionByName(job)
    if with_new:
        new = listed(items.withColumn("k", F.lit(1)), ["k"], F.col("entry"), ["pos"], "\n")
        out = out.unionByName(new.select(F.lit("new-digest").alias("name"), F.concat(F.lit(INSTRUCTIONS["new-digest"] + tail + "New coffees:\n"), F.col("text")).alias("prompt")))
    return out


def with_failures(digest: Column, failed: Sequence[str]) -> Column:
    """A digest with a line for each failed source."""
    if not failed:
        return digest
    footer = FAILED_HEADING + "\n\n" + "\n".join(f"{n} {FAILED_SUFFIX}" for n in failed)
    base = F.regexp_replace(digest, r"(?U)^\s+|\s+$", "")
    return F.concat(F.when(base != "", F.concat(base, F.lit("\n\n"))).otherwise(""), F.lit(footer + "\n"))
