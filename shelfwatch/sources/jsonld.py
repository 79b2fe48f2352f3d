"""Product text from JSON-LD in page HTML.

Finding products in a document of any shape is done in Python, an Arrow batch at a time: each becomes a flat map of
texts. What is told of a product, and in which order, is a column expression over that map.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.functions import text

BLOCK = re.compile(r"""<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", re.I | re.S)
# Types that are products, and where a page names its main thing.
PRODUCTS = {"product", "productgroup"}
MAIN = ("mainEntity", "mainEntityOfPage")


def roots(block: str) -> list[dict]:
    """A block's top-level objects. Text after its first value doesn't matter."""
    try:
        data = json.JSONDecoder().raw_decode(block.strip())[0]
    except json.JSONDecodeError:
        return []
    return [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]


def walked(root: dict) -> Iterator[dict]:
    """An object and all it holds, each before what it holds itself: its main entity, then its graph."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            yield node
            graph = node.get("@graph")
            waiting += reversed([next((node[k] for k in MAIN if node.get(k)), None), *(graph if isinstance(graph, list) else [])])


def is_product(node: dict) -> bool:
    kind = node.get("@type")
    return not PRODUCTS.isdisjoint(str(k).lower() for k in (kind if isinstance(kind, list) else [kind]))


def flat(node: object, at: str = "") -> dict[str, str]:
    """Texts by dotted path; of a list its first object counts."""
    while isinstance(node, list):
        node = next((x for x in node if isinstance(x, dict | list) and x), None)
    if isinstance(node, dict):
        return {k: v for key, x in node.items() for k, v in flat(x, f"{at}.{key}" if at else str(key)).items()}
    return {at: str(node).strip()} if node and str(node).strip() else {}


def products_in(page: str) -> list[dict[str, str]]:
    """Of each top-level object of each block the first product in it, flat."""
    found = []
    for m in BLOCK.finditer(page):
        for root in roots(m[1]):
            found += [flat(n) for n in walked(root) if is_product(n)][:1]
    return found


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def product_maps(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: products_in(p or ""))


def told(product: Column) -> Column:
    """Name, description, brand, SKU, category, price and availability of a flat product; '' if it has none."""
    price = F.concat_ws(" ", product["offers.price"], F.when(product["offers.price"].isNotNull(), product["offers.priceCurrency"]))
    fields = {"Name": product["name"], "Description": product["description"], "Brand": F.coalesce(product["brand.name"], product["brand"]), "SKU": product["sku"], "Category": product["category"], "Price": F.nullif(price, F.lit("")), "Availability": product["offers.availability"]}
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{label}: "), value) for label, value in fields.items()))


def jsonld_text(page: Column) -> Column:
    """What is told of the first product that tells anything; '' without one."""
    return F.coalesce(F.get(F.filter(F.transform(product_maps(page), told), lambda x: x != ""), F.lit(0)), F.lit(""))


def page_text(page: Column, stop_phrases=(), chars: int = 0) -> Column:
    """A page's JSON-LD text, else its visible text, cut at the stop phrases. Pages without a JSON-LD block never reach the UDF's parser."""
    found = F.when(F.contains(F.lower(page), F.lit("application/ld+json")), jsonld_text(page)).otherwise(F.lit(""))
    return text.trimmed_at(text.cap(F.coalesce(F.nullif(found, F.lit("")), text.sanitized(page, 0)), chars), stop_phrases)
