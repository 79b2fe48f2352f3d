"""Whitening of embeddings by a covariance that is computed in tiles.

Vectors of a partition are taken in row blocks of bounded size and cut into column blocks. Column blocks are shuffled by
row block; the task that gets a row block multiplies each pair of its column blocks, whose place in the matrix is the
pair's tile key, and adds up what its row blocks give for each tile. The tasks' tiles are summed per tile by Spark, cell by
cell, so what moves is one matrix for each task and no row. The driver assembles the tiles, as many numbers as the square of the
vectors' width and independent of their number, and finds the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace, batch_of, bound_batches, grouped

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)  # |64 c| of an entry
BLOCK_ROWS, BLOCK_BYTES = 4_096, 16 << 20
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def tile_width(width: int) -> int:
    """Columns of a column block: at most 8 of them make a row block, unless vectors are narrow."""
    return max(16, -(-width // 8))


def usable(v: Column) -> Column:
    """Is an array there, with finite entries only?"""
    return F.coalesce(F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) <= LARGEST)), F.lit(False))


def fit_list(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that count, as whole numbers, and their width."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("c")).where(usable(F.col("c")))
    common = rows.groupBy(F.size("c").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).head()
    width = common.width if common else 0
    whole = F.transform("c", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return rows.where(F.size("c") == width).select("vec_id", whole.alias("v")), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums(rows: DataFrame, width: int, kind: str) -> tuple[int, np.ndarray]:
    """How many rows (v) there are, and their sum by dimension; kind is long, which is exact, or double."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            x = matrix(b.column(0), width)
            n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "total": pa.array([total.tolist()], pa.list_(pa.int64() if kind == "long" else pa.float64()))})

    got = rows.select("v").mapInArrow(partial, f"n long, total array<{kind}>").select("n", F.posexplode("total").alias("at", "x")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("at").collect()
    return (got[0].n if got else 0), np.array([r.x for r in got])


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Numbers in the narrowest type that holds them exactly."""
    kind = "<f8" if x.dtype.kind == "f" else next(t for t in ("<i2", "<i4", "<i8") if not x.size or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max))
    return kind, np.ascontiguousarray(x, kind).tobytes()


def covariance(rows: DataFrame, width: int, n: int, near: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Of rows (v) about their mean, which is near + rest: near is taken off before the shuffle, where whole numbers stay exact, and rest after it; divisor n."""
    tile = tile_width(width)
    starts = list(range(0, width, tile))
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        made = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
        for b in batches:
            x = matrix(b.column(0), width) - near
            for at in range(0, len(x), most):
                yield batch_of(made, zip(*((block, k, *packed(x[at : at + most, s : s + tile])) for k, s in enumerate(starts)), strict=True))
                block += 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for t in grouped(batches, 1):
            cols = {}
            for r in t.to_pylist():
                mean = rest[starts[r["part"]] :][:tile]
                cols[r["part"]] = np.frombuffer(r["data"], r["kind"]).reshape(-1, len(mean)).astype(np.float64) - mean
            for p in cols:
                for q in cols:
                    if p <= q:
                        held[p, q] = held.get((p, q), 0) + cols[p].T @ cols[q]
        made = pa.schema([("p", pa.int32()), ("q", pa.int32()), ("cells", pa.list_(pa.float64()))])
        for (p, q), cells in held.items():
            yield batch_of(made, ([p], [q], [cells.ravel()]))

    blocks = rows.select("v").mapInArrow(column_blocks, "block long, part int, kind string, data binary").repartition("block").sortWithinPartitions("block", "part")
    tiles = blocks.mapInArrow(products, "p int, q int, cells array<double>").select("p", "q", F.posexplode("cells").alias("at", "x")).groupBy("p", "q", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((width, width))
    for (p, q), cells in tiles.toPandas().sort_values("at").groupby(["p", "q"]):
        a, b = starts[p], starts[q]
        own = cells["x"].to_numpy().reshape(min(tile, width - a), -1)
        out[a : a + own.shape[0], b : b + own.shape[1]] = own
        out[b : b + own.shape[1], a : a + own.shape[0]] = own.T
    return out / n


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and, as columns, their eigenvectors, each with its largest entry positive; eigenvalues that are 0 in double precision have no direction and are left out."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > max(e[0], 0) * len(e) * 8 * np.finfo(float).eps).sum()))
    u = u[:, :k]
    return e[:k], u * np.where(u[np.abs(u).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)


def squared_deviation(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n x - total)^2, exactly; None where it is no long."""
    largest = max(abs(n * int(x.max(initial=0)) - int(total.min())), abs(n * int(x.min(initial=0)) - int(total.max())), n * int(np.abs(x).max(initial=0)))
    if largest * largest * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - total) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - total.astype(object)) ** 2).sum(axis=1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null or hold null, NaN or infinite entries are left out, and so are those with an entry beyond 2^34,
    whose whole number has no room, and those of another length than most have (of lengths equally frequent the
    largest holds). Repeated rows count each, and keep their rows, as do null ids. Components of no variance are left out:
    a single vector, or equal ones, have none, and an empty table has no rows. A deviation beyond a long is null.
    Further columns of any name are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows, width = fit_list(vectors, id_col, vector_col)
    n, total = sums(rows, width, "long") if width else (0, np.zeros(0))
    empty = spark.createDataFrame([], OUT)
    if not n:
        return empty
    near = np.array([round(int(t) / n) for t in total], np.int64)
    rest = np.array([(int(t) - n * int(m)) / n for t, m in zip(total, near, strict=True)])
    v = covariance(rows, width, n, near, rest)
    e, u = components(v, most)
    if not len(e):
        return empty
    turned = u / np.sqrt(e)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("v", pa.list_(pa.float64()))])
        for b in batches:
            x = matrix(b.column(1), width)
            yield batch_of(made, (b.column(0), squared_deviation(x, n, total), list(((x - near) - rest) @ turned)))

    ws = Workspace(spark, "whiten")
    out = ws.save(rows.mapInArrow(whitened, "vec_id long, deviation long, v array<double>"), "whitened")
    mean = sums(out, len(e), "double")[1] / n
    error = float(np.abs(covariance(out, len(e), n, np.zeros(len(e)), mean) - np.eye(len(e))).max())
    told = F.element_at(F.array(*(F.lit(float(x)) for x in e / np.trace(v))), F.col("at") + 1)
    each = out.select("vec_id", "deviation", F.posexplode("v").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", told.alias("explained"), F.lit(error).alias("identity_error"))
