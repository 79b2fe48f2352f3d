"""Exact k nearest binary codes by incremental multi-index hashing.

A code's bits are cut into segments of 16; an index holds for each segment which codes have which value there. A search
probes all values within radius r of the query's own, segment by segment, then r + 1, and so on. Once the first s + 1
segments are done with radius r and the others with r - 1, every code within distance m * r + s has been found (m
segments): a farther miss in each would add up to more. The search of a query ends when its k-th verified distance
is no larger, so results are exact, ties included. When the next radius has more probes than the index has codes,
verifying the codes themselves covers every distance at once.

Rows of equal codes are one index entry with its k + 1 smallest ids, since no others can be among the k nearest. Codes
and queries are both rows: codes are hashed into shards, queries into blocks, and each pair of a shard and a block is
a group of bounded size, which builds the shard's index and searches it for the block; there are as many pairs as keep
all tasks busy. Results of the shards meet by query code, of which a rank limit passes on k + 1 each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace, batch_of, grouped, row_count

SEGMENT = 16
SHARD, BLOCK = 200_000, 100_000
AT_ONCE = 2_000_000
FOUND = pa.schema([("q", pa.binary()), ("distance", pa.int32()), ("vec_id", pa.int64()), ("code", pa.binary())])


def codes_of(vectors: DataFrame, bits: int) -> DataFrame:
    """vec_id, code: a bit for each of the first `bits` numbers, set where it is above 0; a missing one, null or NaN leaves it 0. Rows without a vector have no code and go."""
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.zeros(bits, bool)
                got = np.array([e or 0 for e in v.as_py()][:bits], dtype=float)
                x[: len(got)] = got > 0
                out.append((i, np.packbits(x).tobytes()))
            if out:
                yield batch_of(schema, zip(*out, strict=True))

    return vectors.where("vector is not null").mapInArrow(run, "vec_id long, code binary")


def masks(r: int) -> np.ndarray:
    """All segment values with r bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), r)], dtype=np.int64)


class Index:
    """The codes of one shard, by segment value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # one row of segment values (uint16) for each code
        self.n, self.m = codes.shape
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(self.m)]
        self.first = [np.searchsorted(codes[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)]

    def probed(self, queries: np.ndarray, active: np.ndarray, s: int, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) of every code whose segment differs from the query's by one of the flips."""
        values = (queries[active, s].astype(np.int64)[:, None] ^ flips).ravel()
        lo = self.first[s][values]
        size = self.first[s][values + 1] - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        return np.repeat(np.repeat(active, len(flips)), size), self.order[s][at]

    def nearest(self, queries: np.ndarray, counts: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, codes, distances) of all codes up to each query's k-th distance; counts: rows of each code, at most k."""
        per = max(1, AT_ONCE // max(1, self.n))
        for at in range(0, len(queries), per):
            yield from self._some(queries, np.arange(at, min(len(queries), at + per)), counts, k)

    def _some(self, queries: np.ndarray, active: np.ndarray, counts: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        bits, base = SEGMENT * self.m, int(active[0])
        within = np.zeros((len(active), bits + 1), np.int64)  # rows by distance, so far
        found = np.zeros((3, 0), np.int64)
        for r in range(SEGMENT + 1):
            flips = masks(r)
            scan = len(flips) > self.n
            for s in range(self.m):
                q, a = (np.repeat(active, self.n), np.tile(np.arange(self.n), len(active))) if scan else self.probed(queries, active, s, flips)
                each = np.bitwise_count(queries[q] ^ self.codes[a]).astype(np.int64)
                # What an earlier probe has found is left out: by a segment already done with this radius, or by any with the last one.
                new = (each[:, :s] > r).all(axis=1) & (each[:, s if scan else s + 1 :] > r - 1).all(axis=1)
                q, a, d = q[new], a[new], each[new].sum(axis=1)
                np.add.at(within, (q - base, d), counts[a])
                found = np.concatenate([found, np.stack([q, a, d])], axis=1)
                covered = bits if scan or r == SEGMENT else self.m * r + s
                known = np.cumsum(within[active - base], axis=1)
                done = (known[:, covered] >= k) | (covered >= bits)
                if done.any():
                    kth = np.full(len(within), -1, np.int64)
                    kth[active[done] - base] = np.where(known[done, -1] >= k, (known[done] >= k).argmax(axis=1), bits)
                    mine = kth[found[0] - base]
                    yield tuple(found[:, found[2] <= mine])
                    found, active = found[:, mine < 0], active[~done]
                    if not len(active):
                        return


def segments(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), dtype=">u2").reshape(len(codes), -1).astype(np.uint16)


def nearest_codes(vectors: DataFrame, every: int = 20, k: int = 10, bits: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (1 to k), vec_id, distance: for each row whose id is divisible by `every` the k nearest other rows, by Hamming distance, then id.

    A row is no neighbour of itself; rows that repeat id and code are one, a null id is neither query nor neighbour.
    With fewer than k others all are given. An empty table, or one without queries, gives no rows. bits is by default
    the longest vector's length.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "hamming")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector")).where("vec_id is not null")
    bits = bits or rows.agg(F.max(F.size("vector"))).head()[0] or SEGMENT
    bits = max(SEGMENT, -(-bits // SEGMENT) * SEGMENT)
    codes = ws.save(codes_of(rows, bits), "codes")
    nth = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    classes = codes.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = ws.save(classes, "classes")
    queries = codes.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    asked = ws.save(queries.select("code").distinct(), "queries")
    shards, n, parallel = max(1, -(-row_count(classes) // SHARD)), row_count(asked), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK), min(n, -(-2 * parallel // shards)))
    tasks = min(shards * blocks, max(4 * parallel, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    part = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = classes.select(part(shards).alias("shard"), every_one(blocks).alias("block"), "code", "ids")
    rows = held.unionByName(asked.select(part(blocks).alias("block"), every_one(shards).alias("shard"), "code", F.lit(None).cast("array<bigint>").alias("ids")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            query = t.column(3).is_null().to_numpy()
            wanted, code = (t.column(2).filter(pa.array(x)).to_pylist() for x in (query, ~query))
            if not wanted or not code:
                continue
            lists = t.column(3).filter(pa.array(~query)).combine_chunks()
            ids, count = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            first = np.cumsum(count) - count
            for q, a, d in Index(segments(code)).nearest(segments(wanted), count, k + 1):
                size = count[a]
                at = np.arange(size.sum()) + np.repeat(first[a] - np.cumsum(size) + size, size)
                q, a, d, i = *(np.repeat(x, size) for x in (q, a, d)), ids[at]
                q, a, d, i = (x[np.lexsort((a, i, d, q))] for x in (q, a, d, i))
                best = np.arange(len(q)) - np.searchsorted(q, q) <= k  # the first k + 1 of each query
                q, a = q[best].tolist(), a[best].tolist()
                yield batch_of(FOUND, ([wanted[x] for x in q], d[best], i[best], [code[x] for x in a]))

    found = rows.select("shard", "block", "code", "ids").repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block").mapInArrow(search, "q binary, distance int, vec_id long, code binary")
    best = F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id", "code"))
    found = found.withColumn("nth", best).where(F.col("nth") <= k + 1).select("q", "distance", "vec_id", "code")
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    others = own.join(found, "q").where((F.col("query_id") != F.col("vec_id")) | (F.col("q") != F.col("code")))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("distance", "vec_id", "code"))
    return others.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
