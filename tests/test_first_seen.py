"""Keyed first-seen state against the batch fold, over restarts, late rows and an earlier store."""

import pytest
from pyspark.sql import functions as F

from shelfwatch.operators import seen
from shelfwatch.streaming import first_seen

ROW = "hash string, url string, title string, description string, first_seen_at string, shopify_updated_at string, roaster string, platform string, pos int"
BATCHES = [
    [(f"h{i % 5}", f"u{i}", "t", "d", f"2024-01-{28 - i:02}", "x" if i % 3 else "", "", "p", i) for i in range(20)],
    [("h1", "late", "t", "", "2023-01-01", "", "r", "", 1), ("new", "n", "", "", "2024-02-01", "", "", "", 0), ("new", "m", "", "", "2024-02-02", "y", "", "", 1)],
    [("h1", "w", "", "", "2024-03-01", "", "", "q", 0)],
]


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in (first_seen.PROVIDER, "spark.sql.shuffle.partitions")}
    first_seen.keyed_state(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def run(spark, tmp_path, batches, store=None):
    """Each batch by a query of its own, which goes on where the last one ended."""
    (tmp_path / "in").mkdir(exist_ok=True)
    for rows in batches:
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        changes = first_seen.first_seen_changes(spark.readStream.schema(ROW).parquet(f"file://{tmp_path}/in"), "pos", store)
        q = changes.withColumn("batch", F.lit(batches.index(rows))).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        q.awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out")


def last_rows(changes):
    return sorted(tuple(r.last[c] for c in first_seen.COLUMNS) for r in changes.groupBy("hash").agg(F.max_by(F.struct(*first_seen.COLUMNS), "batch").alias("last")).collect())


def by_batches(spark, store, batches):
    for rows in batches:
        store = seen.merged(store, spark.createDataFrame(rows, ROW))
    return sorted(tuple(r[c] for c in first_seen.COLUMNS) for r in store.collect())


def test_restarts_and_late_rows(spark, tmp_path, rocks):
    changes = run(spark, tmp_path, BATCHES)
    assert last_rows(changes) == by_batches(spark, spark.createDataFrame([], seen.SCHEMA), BATCHES)
    assert {(r.hash, r.batch): r.known for r in changes.where("batch > 0").collect()} == {("h1", 1): True, ("new", 1): False, ("h1", 2): True}


def test_beginning_with_a_store(spark, tmp_path, rocks):
    store = spark.createDataFrame([("h1", "old", "o", "", "2020-01-01", "z", "s", ""), ("h9", "idle", "", "", "2020-01-02", "", "", "")], seen.SCHEMA)
    changes = run(spark, tmp_path, BATCHES[:1], store)
    want = [r for r in by_batches(spark, store, BATCHES[:1]) if r[0] != "h9"]
    assert last_rows(changes) == want and {r.hash for r in changes.where("known").collect()} == {"h1"}
