"""What the corpus operators share: row batches, tables in the shared folder, column guards."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a session with a local master (tests) gets a folder of its own, any other an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shelfwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Batches on their way to Python workers end at BATCH_BYTES, unless the session has a smaller bound: a row may be a very long text."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.sql(f"SET {key}").head()["value"].rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


class Workspace:
    """Tables of one run, written below the shared folder, so that a lost executor costs a re-read and no recomputation.

    The folder goes with the session, for results are read from it till then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/shelfwatch/{name}-{uuid.uuid4().hex}"
        self._last: dict[str, str] = {}
        bound_batches(spark)
        self._on(self.root, lambda fs, p: fs.deleteOnExit(p) if fs.mkdirs(p) else None)

    def _on(self, at: str, do):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(at)
        return do(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back; an earlier table of that name is dropped afterwards."""
        at = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.option("compression", "zstd").parquet(at)
        schema = df.schema
        old = self._last.get(name)
        self._last[name] = at
        if old:
            self.drop_path(old)
        return self.spark.read.schema(schema).parquet(at)

    def drop(self, *names: str) -> None:
        for n in names:
            if at := self._last.pop(n, None):
                self.drop_path(at)

    def drop_path(self, at: str) -> None:
        self._on(at, lambda fs, p: fs.delete(p, True))


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, by fixed names: further columns, whatever they are called, can't clash."""
    bound_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and text those of gone (doc_id, text_hash) have; an id alone may be null or repeated."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_id"]) & (text_hash(docs[text_col]) == gone["_hash"]), "left_anti")


def groups_of(batch: pa.RecordBatch, text: int, most_chars: int = 4_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, row after the last, texts) of runs of rows with at most so many characters, a longer text alone; null is ''."""
    col, at, held, out = batch.column(text), 0, 0, []
    for i in range(len(col)):
        t = col[i].as_py() or ""
        if out and held + len(t) > most_chars:
            yield at, i, out
            at, held, out = i, 0, []
        out.append(t)
        held += len(t)
    if out:
        yield at, len(col), out


def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """The tables of rows that agree in the first columns, from batches sorted by these."""
    held: list[pa.Table] = []
    for big in batches:
        for at in range(0, big.num_rows, 2_000):
            held.append(pa.Table.from_batches([big.slice(at, 2_000)]))
            whole = pa.concat_tables(held)
            differs = np.zeros(max(0, whole.num_rows - 1), bool)
            for c in range(columns):
                x = whole.column(c).to_numpy()
                differs |= x[1:] != x[:-1]
            cuts = [0, *(np.flatnonzero(differs) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield whole.slice(a, b - a)
            held = [whole.slice(cuts[-1])]
    if held and held[0].num_rows:
        yield pa.concat_tables(held)


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).head()[0]
