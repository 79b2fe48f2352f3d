"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace

PART_BITS = 33  # of monotonically_increasing_id: the rows of one partition


def numbered(ws: Workspace, df: DataFrame, key: str, order: list[str], name: str, about: DataFrame | None = None) -> DataFrame:
    """df with idx, a row's place from 0 among those of its key in the given order, and n, how many these are.

    Rows are sorted over ranges of (key, order), so a key with most of the rows takes many tasks, and so do rows that
    agree in all of it: a row number decides between them. What the ranges hold of each key is counted; these counts, a
    row for each range and key in it, are summed up by key. The columns of about, a row for each key, come along by these
    counts, so that no join by the key alone has to move a frequent key's rows. The key isn't null. Names that begin with
    _ are taken.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(key, *order, "_row").sortWithinPartitions(key, *order)
    placed = ws.save(rows.drop("_row").withColumn("_at", F.monotonically_increasing_id()), f"{name}_sorted").withColumn("_part", F.shiftright("_at", PART_BITS))
    cells = placed.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(key)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("_part", key, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    further = [] if about is None else [c for c in about.columns if c != key]
    cells = ws.save(cells if about is None else cells.join(about, key), f"{name}_cells")
    return placed.join(cells, ["_part", key]).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "n", *further)
