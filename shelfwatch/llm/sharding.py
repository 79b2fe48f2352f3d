"""Sharding by minimax contiguous partition, in DataFrame operations only.

Documents with equal texts are one atomic group. Groups stand in the order of a 64-bit hash of their text. The
smallest capacity C for which a greedy walk over the group sizes needs no more than n shards is found by binary
search, and the shards are cut where that walk cuts.

The walk needs prefix sums, not rows: Spark sums the sizes by ranges of the hash (65,536 at first), and the driver
searches over those sums. Taking ranges as atomic gives a capacity that is surely enough, taking them as divisible
at will one that is surely needed; only ranges in which a cut can fall for a capacity between the two are summed
again, more finely, until each of them is a single group. So the cuts are exact, while the driver never holds
more than the range sums, whose number depends on n alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace, keyed_text, row_count

FIRST_BITS = 16
MOST_RANGES = 1 << 18
CELL_ROWS = 1_000
OVERHEAD = 8

Range = tuple[int, int, int, int]  # first hash value, bits of it that are fixed, bytes, groups


def fill(prefix: list[int], start: int, capacity: int) -> int:
    """How far a shard gets that begins with item start: the index after its last item."""
    return bisect_right(prefix, prefix[start] + capacity) - 1


def fits(prefix: list[int], capacity: int, shards: int) -> bool:
    """Do so many shards of this capacity hold all items, each item whole?"""
    at, last = 0, len(prefix) - 1
    for _ in range(shards):
        if at == last:
            break
        nxt = fill(prefix, at, capacity)
        if nxt == at:
            return False
        at = nxt
    return at == last


def fits_fluid(prefix: list[int], capacity: int, shards: int) -> bool:
    """The same if items could be cut anywhere."""
    return capacity * shards >= prefix[-1]


def least(ok, lo: int, hi: int) -> int:
    """The smallest value in [lo, hi] for which ok holds; it holds for hi."""
    while lo < hi:
        mid = (lo + hi) // 2
        if ok(mid):
            hi = mid
        else:
            lo = mid + 1
    return lo


def open_ranges(ranges: list[Range], shards: int) -> tuple[int, list[int]]:
    """(a capacity that is enough, indices of the ranges of several groups in which a cut can still fall)."""
    prefix = [0, *accumulate(r[2] for r in ranges)]
    single = max((r[2] for r in ranges if r[3] == 1), default=0)
    hi = least(lambda c: fits(prefix, c, shards), max((r[2] for r in ranges), default=0), prefix[-1])
    lo = least(lambda c: fits_fluid(prefix, c, shards), single, hi)
    found, low, high = set(), 0, 0
    for _ in range(shards):
        low = prefix[max(0, bisect_right(prefix, low + lo) - 1)]  # cuts at range bounds, with the least capacity
        high = min(prefix[-1], high + hi)  # cuts anywhere, with the largest
        first = max(0, bisect_right(prefix, low) - 1)
        found.update(i for i in range(first, min(len(ranges), bisect_left(prefix, high) + 1)) if ranges[i][3] > 1)
    return hi, sorted(found)


def summed(groups: DataFrame, bits: int) -> list[Range]:
    """Bytes and groups by the first bits of the hash, in its order. At most 2**bits rows come to the driver, or as many as the filter on groups lets through."""
    rows = groups.groupBy(F.shiftright("key", 64 - bits).alias("part")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return sorted((r.part << (64 - bits), bits, r.b, r.n) for r in rows)


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """The hash values at which a new shard begins, at most shards - 1, for the smallest feasible capacity."""
    bits = FIRST_BITS
    ranges = summed(groups, bits)
    if not ranges:
        return []
    while True:
        capacity, again = open_ranges(ranges, shards)
        if not again:
            break
        finer = min(64, bits + max(1, min(16, (MOST_RANGES // len(again)).bit_length() - 1)))
        parts = {}
        for i in again:
            parts.setdefault(ranges[i][1], []).append(ranges[i][0] >> (64 - ranges[i][1]))
        where = None
        for b, values in parts.items():
            hit = F.shiftright("key", 64 - b).isin(values)
            where = hit if where is None else where | hit
        opened = set(again)
        ranges = sorted([r for i, r in enumerate(ranges) if i not in opened] + summed(groups.where(where), finer))
        bits = finer
    prefix = [0, *accumulate(r[2] for r in ranges)]
    capacity = least(lambda c: fits(prefix, c, shards), max(r[2] for r in ranges if r[3] == 1) if any(r[3] == 1 for r in ranges) else 1, capacity)
    cuts, at = [], 0
    while (at := fill(prefix, at, capacity)) < len(ranges):
        cuts.append(ranges[at][0])
    return cuts


def shard_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts the key has reached."""
    out = F.lit(0)
    for c in cuts:
        out = out + (key >= F.lit(c).cast("long")).cast("int")
    return out


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row.

    size is the UTF-8 bytes of the text plus 8. Rows with equal texts (null counts as '') are in one shard; the
    largest shard is as small as contiguous cuts in hash order can make it. Two texts with one 64-bit hash are one
    group too. slot numbers a shard's rows from 0 without gaps. Repeated rows and null ids get a slot each; with fewer
    groups than shards the last shards are empty; an empty table gives none. Slots are counted in cells of about a
    thousand rows, dealt by row and not by text, so a text that a third of all rows share is no cell of its own.
    """
    ws = Workspace(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = ws.save(
        keyed_text(docs, id_col, text_col).select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")), "rows"
    )
    groups = ws.save(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    cells = max(1, -(-row_count(rows) // (shards * CELL_ROWS)))
    placed = rows.select("*", shard_of(F.col("key"), cut_keys(groups, shards)).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(cells)).alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "doc_id", "row"))
    return placed.withColumn("nth", nth).join(first, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
