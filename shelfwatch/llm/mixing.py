"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be taken the same number of times, the source's target over its size, which is seldom
whole. Its whole part is taken; what is left of it, as words of the document, is a mass between nothing and all of them.
Two documents are paired: mass goes from one to the other until one has none or all of its words, as much and in such a
direction, drawn at random, that either's mass stays the same on average and their sum stays the same for certain. The
one that is whole is decided, the other goes on to the next pair.

Documents stand by falling size, so that pairs are alike and small ones are left for the end. Within a group of 64
neighbours this is a fold, which leaves one residual. Residuals are the
units of the next level, 64 of them a group again, up to one group for each source: a reduction tree whose tables become
64 times smaller with each level. At the end the last residual is drawn, and decisions go down the tree again. So the
words taken of a source differ from its target by less than one document, mostly a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace
from shelfwatch.llm.ranks import numbered

WEIGHTS = (5, 2, 1)
MOST = 3
GROUP_BITS = 6
SPACE = " \t\n\x0b\x0c\r"
DECIDED = "array<struct<at:int,full:boolean>>"


def words(text: Column) -> Column:
    """The number of runs of anything but white space; null has none."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), SPACE, "")).cast("long")


def share_level(sources: DataFrame, most: int) -> float:
    """Words for each unit of weight, so that all sources, held at `most` times their size, share what there is; sources: (total, weight).

    Each turn reshares what sources above their bound leave, one row comes to the driver, and the level only rises.
    """
    level, held = 0.0, -1
    while True:
        above = most * F.col("total") <= F.col("weight") * F.lit(level)
        r = sources.agg(F.sum("total").alias("all"), F.sum(F.when(above, most * F.col("total"))).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("held")).head()
        if r.held == held or not r.open:
            return level
        held, level = r.held, max(level, (r["all"] - (r.fixed or 0)) / r.open)


def with_targets(ws: Workspace, rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(key, source_size, target) of each source of rows (key, size)."""
    totals = ws.save(rows.groupBy("key").agg(F.sum("size").alias("total")), "totals")
    ranked = numbered(ws, totals.withColumn("all", F.lit(0)), "all", ["key"], "ranked")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int"))
    sources = ws.save(ranked.select("key", "total", weight.alias("weight")), "sources")
    level = share_level(sources, most)
    return sources.select("key", F.col("total").alias("source_size"), F.least(F.lit(float(most)) * F.col("total"), F.col("weight") * F.lit(level)).alias("target"))


def draw(seed: int, level: int, *place: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the place."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), *place), 11) / F.lit(float(1 << 53))


def settled(carry: Column, x: Column) -> Column:
    """One pair: the carried unit i and the next one j, (at, size, mass) each, j with its draw u; the decided one goes to out."""
    i_room, j_room = carry["size"] - carry["mass"], x["size"] - x["mass"]
    takes, gives = F.least(i_room, x["mass"]), F.least(carry["mass"], j_room)
    taking = x["u"] * (takes + gives) < gives

    def state(kept: Column, mass: Column, done: Column, full) -> Column:
        decided = F.array(F.struct(done["at"].alias("at"), (full if isinstance(full, Column) else F.lit(full)).alias("full")))
        return F.struct(kept["at"].alias("at"), kept["size"].alias("size"), mass.alias("mass"), F.concat(carry["out"], decided).alias("out"))

    whole = lambda y: (y["mass"] <= 0) | (y["mass"] >= y["size"])
    return (
        F.when(whole(carry), state(x, x["mass"], carry, carry["mass"] > 0))
        .when(whole(x), state(carry, carry["mass"], x, x["mass"] > 0))
        .when(taking & (i_room <= x["mass"]), state(x, x["mass"] - i_room, carry, True))
        .when(taking, state(carry, carry["mass"] + x["mass"], x, False))
        .when(carry["mass"] <= j_room, state(x, x["mass"] + carry["mass"], carry, False))
        .otherwise(state(carry, carry["mass"] - j_room, x, True))
    )


def folded(units: DataFrame, keys: list[str], level: int, seed: int) -> DataFrame:
    """(keys, block, units, out, rest): groups of neighbours among units (keys, idx, unit), with what is decided in them and their residual. A unit has size and mass."""
    blocks = units.groupBy(*keys, F.shiftright("idx", GROUP_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "unit"))).alias("own"))
    placed = blocks.withColumn("units", F.transform("own", lambda x: x["unit"])).drop("own")
    told = F.transform("units", lambda x, i: F.struct(i.alias("at"), x["size"].alias("size"), x["mass"].alias("mass"), draw(seed, level, F.col("key"), F.col("block"), i).alias("u")))
    placed = placed.withColumn("told", told)
    first = F.element_at("told", 1)
    start = F.struct(first["at"].alias("at"), first["size"].alias("size"), first["mass"].alias("mass"), F.array().cast(DECIDED).alias("out"))
    rest = F.aggregate(F.slice("told", F.lit(2), F.size("told")), start, settled)
    return placed.withColumn("rest", rest).select(*keys, "block", "units", "rest")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, source, text).

    Sources in the order of code points, null as one more at the end, weigh what `weights` says, over and over. Repeated
    rows are documents each, and so are rows of one id or none. Null and empty texts have size 0 and are taken 0 times;
    a source of such texts alone has target 0 and leaves its share to the others. An empty table has no rows. What
    is drawn depends on a document's place among its source's, by size and id, so reruns agree however rows are
    partitioned. Further columns of any name are ignored.
    """
    ws = Workspace(docs.sparkSession, "mix")
    key = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(">"))
    rows = ws.save(docs.select(docs["doc_id"].cast("long").alias("doc_id"), key.alias("key"), words(docs["text"].cast("string")).alias("size")), "rows")
    keys = ["key", "source_size", "target"]
    placed = numbered(ws, rows.withColumn("rank", -F.col("size")), "key", ["rank", "doc_id"], "rows", with_targets(ws, rows, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    unit = F.struct("doc_id", "size", (F.col("size") * (rate - F.floor(rate))).alias("mass"))
    largest = placed.agg(F.max("n")).head()[0] or 1
    levels = [ws.save(folded(placed.select(*keys, "idx", unit.alias("unit")), keys, 0, seed), "fold_0")]
    while largest > 1 << GROUP_BITS * len(levels):
        residuals = levels[-1].select(*keys, F.col("block").alias("idx"), F.struct(F.col("rest.size").alias("size"), F.col("rest.mass").alias("mass")).alias("unit"))
        levels.append(ws.save(folded(residuals, keys, len(levels), seed), f"fold_{len(levels)}"))
    last = draw(seed, -1, F.col("key")) * F.col("rest.size") < F.col("rest.mass")
    known = levels[-1].select("key", F.col("block"), last.alias("full"))
    for k in reversed(range(len(levels))):
        both = levels[k].join(known, ["key", "block"]).withColumn("all", F.array_sort(F.concat("rest.out", F.array(F.struct(F.col("rest.at").alias("at"), F.col("full").alias("full"))))))
        if k:
            known = ws.save(both.select("key", F.inline(F.transform("all", lambda x: F.struct((F.shiftleft("block", GROUP_BITS) + x["at"]).alias("block"), x["full"].alias("full"))))), f"known_{k}")
    taken = lambda x, i: (x["size"] * (F.floor(rate) + F.element_at("all", i + 1)["full"].cast("long"))).cast("long")
    return both.select("source_size", "target", F.inline(F.transform("units", lambda x, i: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), taken(x, i).alias("taken"))))).select("doc_id", "size", "source_size", "target", "taken")
