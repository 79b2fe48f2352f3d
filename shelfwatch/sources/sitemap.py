"""Product sitemaps: captured XML (url, xml) to last-modified dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import urls

MOST_FETCHES = 8
CHILD = "store-products-sitemap"
ROOTS = ("store-products-sitemap.xml", "sitemap.xml")


def _plain(xml: Column) -> Column:
    """Without declarations of namespaces and their prefixes."""
    x = F.regexp_replace(xml, r"""\sxmlns(:\w+)?\s*=\s*("[^"]*"|'[^']*')""", "")
    return F.regexp_replace(F.regexp_replace(x, r"(</?)[A-Za-z_][\w.\-]*:", "$1"), r"""\s[A-Za-z_]\w*:\w+\s*=\s*("[^"]*"|'[^']*')""", "")


def root_of(xml: Column) -> Column:
    return F.lower(F.regexp_extract(_plain(xml), r"^\s*(?:<[?!][^>]*>\s*)*<([A-Za-z]+)", 1))


def _parsed(xml: Column) -> DataFrame:
    return F.from_xml(_plain(xml), F.lit("url array<struct<loc:string,lastmod:string>>, sitemap array<struct<loc:string>>"))


def lastmods(sitemaps: DataFrame) -> DataFrame:
    """(pos, item, url, lastmod) of url sets; entries need both; a URL with a slash at its end also counts without. Malformed XML gives none."""
    rows = sitemaps.where(root_of(F.col("xml")) == "urlset").select("pos", F.posexplode(_parsed(F.col("xml"))["url"]).alias("item", "u"))
    rows = rows.select("pos", "item", urls.canonical(F.trim("u.loc")).alias("url"), F.trim("u.lastmod").alias("lastmod")).where("url <> '' and lastmod <> ''")
    both = F.when(urls.path(F.col("url")).rlike("./$"), F.array("url", F.regexp_replace("url", "/+$", ""))).otherwise(F.array("url"))
    return rows.select("pos", "item", F.explode(both).alias("url"), "lastmod")


def children(sitemaps: DataFrame) -> DataFrame:
    """(url, pos, item, child) of index files, for children that are product sitemaps."""
    rows = sitemaps.where(root_of(F.col("xml")) == "sitemapindex").select("url", "pos", F.posexplode(_parsed(F.col("xml"))["sitemap"]).alias("item", "s"))
    return rows.select("url", "pos", "item", F.trim("s.loc").alias("child")).where(F.contains(F.lower("child"), F.lit(CHILD)))


def product_lastmods(captured: DataFrame, base_url: str, include=(), exclude=()) -> DataFrame:
    """(url, lastmod) of a source: from store-products-sitemap.xml and what it leads to, else from sitemap.xml; of a URL's dates the last read counts.

    captured is (url, xml) of all fetched files. The walk over index files is a driver loop of at most eight files.
    """
    for root in ROOTS:
        queue, seen = [f"{base_url.rstrip('/')}/{root}"], []
        while queue and len(seen) < MOST_FETCHES:
            now = queue.pop(0)
            if now not in seen:
                seen.append(now)
                here = captured.where(F.col("url") == now).withColumn("pos", F.lit(len(seen)))
                queue += [r.child for r in children(here).orderBy("item").collect()]
        order = F.create_map(*(x for i, u in enumerate(seen) for x in (F.lit(u), F.lit(i))))
        walked = captured.where(F.col("url").isin(seen)).withColumn("pos", order[F.col("url")])
        found = lastmods(walked).where(urls.matches(F.col("url"), include, exclude))
        found = found.groupBy("url").agg(F.max_by("lastmod", F.struct("pos", "item")).alias("lastmod"))
        if not found.isEmpty():
            return found
    return found
