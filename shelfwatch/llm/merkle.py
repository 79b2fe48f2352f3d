"""A Merkle manifest of a table, with a proof for each row found by coordinates.

Each row is a leaf. Leaves stand in trees, one for each language, whose nodes have eight children; the trees' roots,
ordered by language, are the leaves of one more tree, and its root stands for the table. A node's coordinate is
(tree, level, idx). All nodes are written to one table.

What a proof needs follows from a leaf's index and the number of leaves alone: on each level the others of the run of
eight that its ancestor is in. These coordinates are exploded, joined with the table of nodes, put in order,
concatenated and folded. Leaves of one run need the same nodes, and so do all runs below one node, so coordinates are
looked up once for each run on the lowest levels and once for each node on levels 4, 7 and so on. That way no
node is asked for by more than 512 others, however large the tree, and a leaf's path is its run's, its ancestor's on level
4, that one's ancestor's on level 7, and so on, one after the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace
from shelfwatch.llm.ranks import numbered

FAN_BITS = 3  # 8 children
STRIDE = 3  # levels that are built, or looked up, at once
TOP = "/"  # the tree of trees; the others are named "" (no language) or "=" and the language
NODE = "tree string, n long, level int, idx long, hash string"
STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256."""
    return F.sha2(text, 256)


def field(c: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon and itself; - for null."""
    shown = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def height(n: Column) -> Column:
    """Levels above the leaves until one node is left."""
    return F.when(n > 1, F.ceil(F.length(F.bin(n - 1)) / FAN_BITS)).otherwise(0).cast("int")


def up(idx: Column, levels: Column) -> Column:
    """The index of a node's ancestor so many levels above."""
    return F.call_function("shiftright", idx, (levels * FAN_BITS).cast("int"))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, tampered): leaf hashes of the rows, and of the rows as tampered with, where 3 divides the CRC-32 of the id."""
    whole = [docs["doc_id"].cast("long"), docs["source"], docs["lang"], docs["n_chars"].cast("long")]
    text = docs["text"].cast("string")
    own = digest(F.concat(*map(field, whole), field(text)))
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(whole[0].cast("string")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("="), docs["lang"].cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), whole[0].alias("doc_id"), own.alias("leaf"), F.when(hit, digest(F.concat(*map(field, whole), field(lowered)))).alias("tampered"))


def next_level(hashes: Column) -> Column:
    """The hashes of the nodes above an array of neighbours, whose first begins a run."""
    run = 1 << FAN_BITS
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / run).cast("int")), lambda i: digest(F.array_join(F.slice(hashes, i * run + 1, run), "")))


def climbed(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of the next STRIDE levels above those of one level, as far as their trees go."""
    blocks = nodes.groupBy("tree", "n", F.shiftright("idx", FAN_BITS * STRIDE).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("own"))
    blocks = blocks.withColumn("l0", F.transform("own", lambda x: x["hash"]))
    for k in range(STRIDE):
        blocks = blocks.withColumn(f"l{k + 1}", next_level(F.col(f"l{k}")))

    def made(k: int) -> Column:
        first = F.shiftleft("block", FAN_BITS * (STRIDE - k))
        return F.transform(f"l{k}", lambda x, i: F.struct(F.lit(level + k).alias("level"), (first + i).alias("idx"), x.alias("hash")))

    return blocks.select("tree", "n", F.inline(F.concat(*map(made, range(1, STRIDE + 1))))).where(F.col("level") <= height(F.col("n")))


def built(ws: Workspace, bottom: DataFrame, name: str) -> tuple[DataFrame, int]:
    """All nodes above and including a level 0 (tree, n, idx, hash), as a table, and the height of the tallest tree."""
    parts = [bottom.select("tree", "n", F.lit(0).alias("level"), "idx", "hash")]
    tallest = bottom.agg(F.max(height(F.col("n")))).head()[0] or 0
    for level in range(0, tallest, STRIDE):
        parts.append(ws.save(climbed(parts[-1].where(F.col("level") == level), level), f"{name}_{level}"))
    return reduce(DataFrame.unionByName, parts), tallest


def wanted(unit: Column, n: Column, base: int) -> Column:
    """Coordinates (level, idx) that a node on level base needs for STRIDE levels from its own on; for one on level 1 also its children, each of which needs the others."""
    run = 1 << FAN_BITS

    def around(level: int) -> Column:
        own = F.shiftright(unit, FAN_BITS * (level - base))
        start = F.shiftleft(F.shiftright(own, FAN_BITS), FAN_BITS)
        there = F.sequence(start, F.least(start + run - 1, F.shiftright(n - 1, FAN_BITS * level)))
        return F.transform(F.filter(there, lambda i: i != own), lambda i: F.struct(F.lit(level).alias("level"), i.alias("idx")))

    own = []
    if base == 1:
        first = F.shiftleft(unit, FAN_BITS)
        own.append(F.transform(F.sequence(first, F.least(first + run - 1, n - 1)), lambda i: F.struct(F.lit(0).alias("level"), i.alias("idx"))))
    return F.concat(*own, *(around(level) for level in range(base, base + STRIDE)))


def joined(hashes: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(hashes, keep), lambda x: x["hash"]), "")


def beside(base: int) -> Callable[[Column], Column]:
    """What stands left and right of a unit's ancestor on a level, from what was found."""

    def step(level: Column) -> Column:
        own = up(F.col("unit"), level - base)
        side = lambda keep: joined(F.col("found"), lambda x: (x["level"] == level) & keep(x["idx"]))
        return F.struct(side(lambda i: i < own).alias("left"), side(lambda i: i > own).alias("right"))

    return step


def paths(ws: Workspace, nodes: DataFrame, tallest: int, above: DataFrame, name: str) -> DataFrame:
    """(tree, n, unit, members, steps, subroot, root) for each run of leaves: their hashes, and what stands left and right of the run's node and of its ancestors on each level, up to the root of all.

    above (tree, n, steps, subroot, root) has what comes after a tree's own root.
    """
    found = None
    for base in reversed(range(1, max(2, tallest), STRIDE)):
        if base == 1:
            units = nodes.where((F.col("level") == 0) & (F.col("idx") % (1 << FAN_BITS) == 0)).select("tree", "n", F.shiftright("idx", FAN_BITS).alias("unit"))
        else:
            units = nodes.where((F.col("level") == base) & (height(F.col("n")) > base)).select("tree", "n", F.col("idx").alias("unit"))
        asked = units.select("tree", "n", "unit", F.explode_outer(wanted(F.col("unit"), F.col("n"), base)).alias("at")).select("tree", "n", "unit", F.col("at.level").alias("level"), F.col("at.idx").alias("idx"))
        there = nodes.where(F.col("level").between(base - (base == 1), base + STRIDE - 1)).select("tree", "level", "idx", "hash")
        got = asked.join(there, ["tree", "level", "idx"], "left").groupBy("tree", "n", "unit").agg(F.array_sort(F.collect_list(F.struct("level", "idx", "hash"))).alias("found"))
        last = F.least(F.lit(base + STRIDE), height(F.col("n"))) - 1

        steps = F.when(last >= base, F.transform(F.sequence(F.lit(base), last), beside(base))).otherwise(F.array().cast(STEPS))
        members = F.transform(F.filter("found", lambda x: x["level"] == 0), lambda x: x["hash"])
        own = got.select("tree", "n", "unit", members.alias("members"), steps.alias("own"), F.shiftright("unit", FAN_BITS * STRIDE).alias("parent"))
        short = above.where(height(F.col("n")) <= base + STRIDE).select("tree", F.lit(0).cast("long").alias("parent"), "steps", "subroot", "root")
        further = short if found is None else short.unionByName(found.select("tree", F.col("unit").alias("parent"), "steps", "subroot", "root"))
        found = own.join(further, ["tree", "parent"]).select("tree", "n", "unit", "members", F.concat("own", "steps").alias("steps"), "subroot", "root")
        if base > 1:
            found = ws.save(found, f"{name}_{base}")
    return found


def with_own_run(idx: Column, n: Column, members: Column, steps: Column) -> Column:
    """All steps of a leaf: among the others of its run, then its run's."""
    at = F.pmod(idx, F.lit(1 << FAN_BITS)).cast("int")
    own = F.struct(F.array_join(F.slice(members, F.lit(1), at), "").alias("left"), F.array_join(F.slice(members, at + 2, F.lit(1 << FAN_BITS)), "").alias("right"))
    return F.concat(F.when(n > 1, F.array(own)).otherwise(F.array().cast(STEPS)), steps)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs (doc_id, source, lang, n_chars, text).

    Any column may be null: it enters its leaf as -, and rows without a language are a tree of their own. Within a
    language null ids come first, rows of one id stand in the order of their leaves, and repeated rows are leaves each.
    An empty text is no null. A lone leaf is its own subroot, one language's subroot the root; a proof without siblings is
    the hash of nothing. folded_root is folded for every row, from the tampered leaf where there is one; a null id isn't
    tampered with, and a tampered row without a capital letter verifies. An empty table has no rows. Further columns of
    any name are ignored; a table without one of the five is an error.
    """
    ws = Workspace(docs.sparkSession, "manifest")
    bottom = numbered(ws, ws.save(leaves(docs), "leaves"), "tree", ["doc_id", "leaf"], "leaves")
    bottom = ws.save(bottom, "bottom")
    ws.drop("leaves", "leaves_sorted", "leaves_cells")
    nodes, tallest = built(ws, bottom.withColumnRenamed("leaf", "hash"), "nodes")
    roots = ws.save(nodes.where(F.col("level") == height(F.col("n"))).select("tree", F.col("n").alias("leaves"), "hash"), "roots")
    tops = numbered(ws, roots.withColumn("top", F.lit(TOP)), "top", ["tree"], "tops")
    top_nodes, top_height = built(ws, tops.select(F.col("top").alias("tree"), "n", "idx", "hash"), "top")
    none = F.array().cast(STEPS)
    root = top_nodes.where(F.col("level") == height(F.col("n"))).select("tree", "n", none.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    top_runs = paths(ws, top_nodes, top_height, root, "top_paths")
    joined_top = tops.select("tree", "leaves", "hash", "idx", F.shiftright("idx", FAN_BITS).alias("unit")).join(top_runs.drop("tree"), "unit")
    above = ws.save(joined_top.select("tree", F.col("leaves").alias("n"), with_own_run(F.col("idx"), F.col("n"), F.col("members"), F.col("steps")).alias("steps"), F.col("hash").alias("subroot"), "root"), "above")
    runs = paths(ws, nodes, tallest, above, "paths")
    rows = bottom.withColumn("unit", F.shiftright("idx", FAN_BITS)).join(runs.drop("n"), ["tree", "unit"])
    rows = rows.select("doc_id", "leaf", "tampered", "subroot", "root", with_own_run(F.col("idx"), F.col("n"), F.col("members"), F.col("steps")).alias("path"))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
