"""Order-aware relational operators. Order always comes from columns, never from partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth_below(df: DataFrame, keys: list[str], order: list, most: int, own: Column | None = None) -> DataFrame:
    """The first rows of each key, with own no more than it says for a row's key. The rank limit is applied before the shuffle too, so a hot key sends that many rows a task."""
    name = "nth"
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn(name, nth).where(F.col(name) <= most)
    return (out if own is None else out.where(F.col(name) <= own)).drop(name)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return nth_below(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key, at least one."""
    return nth_below(df, keys, order, max(1, n))


def last_wins(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The value of each key's last row, by partial aggregation."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def ordered_union(*groups: DataFrame, column: str = "name") -> DataFrame:
    """(column, pos): the names of all groups, trimmed, blank ones gone, each where it comes first. Groups have columns pos and `column`."""
    tagged = [g.select(F.lit(k).alias("grp"), "pos", F.trim(column).alias(column)).where(F.col(column) != "") for k, g in enumerate(groups)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    first = union.groupBy(column).agg(F.min(F.struct("grp", "pos")).alias("first"))
    return first.select(column, F.col("first.grp").alias("grp"), F.col("first.pos").alias("pos"))


def listed(df: DataFrame, keys: list[str], text: Column, order: list, separator: str, name: str = "text") -> DataFrame:
    """Each key's texts in order, joined. A key's rows come together: for keys of bounded size (a report, a conversation)."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), text.alias("t")))).alias("rows"))
    return rows.select(*keys, F.array_join(F.transform("rows", lambda r: r["t"]), separator).alias(name))


def keyword_hit(columns: list[Column], keywords: list[str], hyphenated: Column | None = None) -> Column:
    """Is a keyword part of one of the columns, or, its blanks as hyphens, of `hyphenated`?"""
    out = F.lit(False)
    for k in keywords:
        for c in columns:
            out = out | F.contains(c, F.lit(k))
        if hyphenated is not None:
            out = out | F.contains(hyphenated, F.lit(k.replace(" ", "-")))
    return out


def tagged_ok(tags: Column, kind: Column, title: Column, include_tags: list[str], exclude_tags: list[str], include_kinds: list[str], exclude_kinds: list[str], keywords: list[str]) -> Column:
    """The include and exclude rules of a source; an empty include list is no rule. tags is an array, null as empty; keywords are sought in the title in lower case."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    has = lambda xs: F.exists(tags, lambda t: t.isin(list(xs)))
    ok = F.lit(True)
    if include_tags:
        ok = ok & has(include_tags)
    if exclude_tags:
        ok = ok & ~has(exclude_tags)
    if include_kinds:
        ok = ok & kind.isin(list(include_kinds))
    if exclude_kinds:
        ok = ok & ~kind.isin(list(exclude_kinds))
    return ok & ~keyword_hit([F.lower(title)], [k.lower() for k in keywords if k])
