"""Which catalog items are new: dates from the items, pages, sitemaps or the first-seen store, within a window of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions import dates
from shelfwatch.functions.hashing import seen_hash


def marked(rows: DataFrame, store: DataFrame, run_day, days: int, persist: bool, key: str = "hash", order: list | None = None) -> DataFrame:
    """rows with day, date_source, undated, outside, is_new.

    rows have published, modified, lastmod (text, '' if missing) and the key; store has the key and first_seen_at.
    With persist an unknown item is recorded when met: it counts as undated, gets run_day and is new, and a later row of
    its key is dated by that record; order says which row is later, and rows of one place are met together. Without,
    an unknown item is undated and outside. Keys are not null.
    """
    seen = store.select(key, F.col("first_seen_at").alias("_seen_at"))
    joined = rows.join(seen, key, "left")
    found = dates.cascade(F.col("published"), F.col("modified"), F.col("lastmod"), F.coalesce("_seen_at", F.lit("")))
    out = joined.withColumn("_found", found)
    day, source = F.col("_found.date"), F.col("_found.source")
    if persist:
        # The first row of a key comes from partial aggregation, so a hot key is one row of the join's other side.
        place = F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order or ["pos"])))
        first = rows.groupBy(key).agg(F.min(place).alias("_first"))
        out = out.join(first, key).withColumn("_again", place != F.col("_first"))
        undated = day.isNull() & ~F.col("_again")
        source = F.when(undated, "undated").when(day.isNull(), "seen_at").otherwise(source)
        inside = dates.in_window(F.coalesce(day, run_day), run_day, days)
    else:
        undated = day.isNull()
        inside = F.coalesce(dates.in_window(day, run_day, days), F.lit(False))
    return out.select(*rows.columns, F.coalesce(day, run_day if persist else day).alias("day"), source.alias("date_source"), undated.alias("undated"), (~inside).alias("outside"), inside.alias("is_new"))


def counts(classified: DataFrame) -> DataFrame:
    """One row: new items by date source, undated, outside."""
    by = [F.count_if(F.col("is_new") & (F.col("date_source") == s)).alias(s) for s in dates.SOURCES]
    return classified.agg(*by, F.count_if("undated").alias("undated"), F.count_if("outside").alias("outside_window"), F.count_if("is_new").alias("new_rows"))


def described(products: DataFrame, descriptions: DataFrame, modified: DataFrame, lastmods: DataFrame) -> DataFrame:
    """products with description, modified, lastmod and hash. The three tables are (url, value, pos); of a URL's rows the last counts, for all products of that URL."""

    def last(df: DataFrame, value: str, name: str) -> DataFrame:
        return df.groupBy("url").agg(F.max_by(value, "pos").alias(name))

    out = products
    for df, value, name in ((descriptions, "description", "description"), (modified, "modified", "modified"), (lastmods, "lastmod", "lastmod")):
        out = out.join(last(df, value, name), "url", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out.withColumn("published", F.coalesce("shopify_published_at", F.lit(""))).withColumn("hash", seen_hash(F.col("url"), F.col("name"), F.col("description")))


def new_items(items: DataFrame, classified: DataFrame) -> DataFrame:
    """Items whose URL belongs to any new row."""
    return items.where("url <> ''").join(classified.where("is_new").select("url").distinct(), "url", "left_semi")
