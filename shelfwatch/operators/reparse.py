"""Reports read again: item rows from their lists, failed and missing sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions import urls
from shelfwatch.operators.render import FAILED_SENTINEL, FAILED_SUFFIX, LIST_HEADING

FIELDS = {"name": "name:", "url": "url:", "list_price": "list price:", "badge": "badge:"}


def _after(c: Column, prefix: str) -> Column:
    return F.trim(c.substr(F.lit(len(prefix) + 1), F.length(c)))


def lines_of(reports: DataFrame) -> DataFrame:
    """(file_name, n, line, s): the lines of each report in order, s without blanks at its ends."""
    split = reports.select("file_name", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("n", "line"))
    return split.withColumn("s", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))


def items(reports: DataFrame) -> DataFrame:
    """(file_name, item, roaster, product_id, name, url, list_price, badge, description, variant_lines) from the lists of reports.

    A line of an item means what the last line that matters before it makes of it, which running windows over a report's
    lines tell: the list starts at its heading and ends at the next; '- ' outside variants begins an item, a blank line ends
    one; under variants: '- ' lines are variants; the line after a bare description: is one. In a report's list of old
    style '- Name (http...)' is an item by itself.
    """
    w = Window.partitionBy("file_name").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines_of(reports)
    names = rows.where(F.col("line").startswith("Roaster: ")).groupBy("file_name").agg(F.min_by("line", "n").alias("line"))
    names = names.select("file_name", _after(F.col("line"), "Roaster: ").alias("told"))
    rows = rows.withColumn("began", F.max(F.when(F.col("s") == LIST_HEADING, F.col("n"))).over(w)).where(F.col("began").isNotNull() & (F.col("s") != LIST_HEADING))
    rows = rows.withColumn("over", F.count_if(F.col("line").startswith("## ")).over(w)).where("over = 0")
    start = F.col("line").startswith("- ")
    rows = rows.withColumns({"start": start, "item": F.count_if(start).over(w)}).where("item > 0")
    # An item ends at its first blank line, or at once if its first line names no product_id.
    own = Window.partitionBy("file_name", "item").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("start") & F.trim(F.substring("line", 3, 1_000_000)).startswith("product_id:")
    rows = rows.withColumns({"ended": F.count_if(F.col("s") == "").over(own), "full": F.max(opens).over(own)})
    rows = rows.where(F.col("start") | ((F.col("ended") == 0) & F.col("full")))
    s = F.col("s")
    is_field = F.lit(False)
    for prefix in FIELDS.values():
        is_field = is_field | s.startswith(prefix)
    mark = F.when(F.col("start") | is_field, "field").when(s == "variants:", "variants").when(s.startswith("description:"), F.when(s == "description:", "wait").otherwise("field"))
    before = Window.partitionBy("file_name", "item").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mark", mark).withColumn("state", F.last("mark", ignorenulls=True).over(before))
    # After description: only the next unmarked line is one.
    since = Window.partitionBy("file_name", "item", "marks").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("marks", F.count("mark").over(own)).withColumn("spent", F.count_if(F.col("mark").isNull()).over(since))
    free = F.col("mark").isNull()
    variant = free & (F.col("state") == "variants") & s.startswith("- ") & (_after(s, "- ") != "")
    desc = F.when(s.startswith("description:") & (s != "description:"), _after(s, "description:")).when(free & (F.col("state") == "wait") & (F.col("spent") == 0), s)
    entry = F.trim(F.substring("line", 3, 1_000_000))
    legacy = entry.rlike(r"^.* \(http[^ ]*\)$") | entry.rlike(r" \(http.*\)$")
    last = lambda value, when: F.coalesce(F.max_by(F.when(when, value), F.when(when, F.col("n"))), F.lit(""))
    not_start = ~F.col("start")
    old_name = F.when(legacy, F.trim(F.regexp_extract(entry, r"^(.*) \(([^(]|\((?!http))*\)$", 1))).otherwise(entry)
    old_url = F.when(legacy, F.regexp_extract(entry, r"^.* \((http.*)\)$", 1)).otherwise("")
    out = rows.groupBy("file_name", "item").agg(
        F.max("full").alias("full"),
        F.max(F.when(F.col("start"), entry)).alias("entry"),
        last(_after(entry, "product_id:"), opens).alias("product_id"),
        *(last(_after(s, p), not_start & s.startswith(p)).alias(c) for c, p in FIELDS.items()),
        last(desc, not_start & desc.isNotNull()).alias("description"),
        F.max(F.when(F.col("start"), old_name)).alias("old_name"),
        F.max(F.when(F.col("start"), old_url)).alias("old_url"),
        F.array_sort(F.collect_list(F.when(s == "variants:", F.struct("n", F.lit("  variants:").alias("t"))).when(variant, F.struct("n", F.concat(F.lit("    - "), _after(s, "- ")).alias("t"))))).alias("v"),
    ).where("full or entry <> ''")
    out = out.join(names, "file_name", "left")
    name, url = F.when(F.col("full"), F.col("name")).otherwise(F.col("old_name")), F.when(F.col("full"), F.col("url")).otherwise(F.col("old_url"))
    out = out.select("file_name", "item", F.coalesce(F.nullif("told", F.lit("")), "file_name").alias("roaster"), "product_id", name.alias("name"), url.alias("url"), "list_price", "badge", "description", F.transform("v", lambda x: x["t"]).alias("variant_lines"))
    return out.withColumn("product_id", F.when((F.col("product_id") == "") & (F.col("url") != ""), urls.id_of(F.col("url"))).otherwise(F.col("product_id")))


def is_failed(report: Column) -> Column:
    """The sentinel anywhere, or a line that ends in the failure suffix."""
    return F.contains(report, F.lit(FAILED_SENTINEL)) | F.exists(F.split(report, "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "").endswith(FAILED_SUFFIX))


def failed_names(reports: DataFrame) -> DataFrame:
    """(name, pos): sources that reports (file_name, text, pos) call failed, each where it is first named. A line without a name counts for the last source named above it."""
    w = Window.partitionBy("file_name").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines_of(reports).join(reports.select("file_name", "pos"), "file_name")
    s = F.col("s")
    rows = rows.withColumn("source", F.coalesce(F.last(F.when(s.startswith("Roaster: "), _after(s, "Roaster: ")), ignorenulls=True).over(w), F.lit("")))
    named = F.when(s == FAILED_SENTINEL, F.col("source")).when(s.endswith(FAILED_SUFFIX), F.coalesce(F.nullif(F.trim(F.regexp_replace(s, f"{FAILED_SUFFIX}$", "")), F.lit("")), F.col("source")))
    return rows.select(named.alias("name"), F.struct("pos", "n").alias("pos")).where("name <> ''").groupBy("name").agg(F.min("pos").alias("pos"))


def resume_targets(sources: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Sources without a report, or with one that failed. reports: (key, text)."""
    found = reports.select(key, F.lit(True).alias("_there"), is_failed(F.col("text")).alias("_failed"))
    return sources.join(found, key, "left").where("_there is null or _failed").select(*sources.columns)


def missing(sources: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    return sources.join(reports.select(key), key, "left_anti")
