"""First-seen state over a stream of observations: folded into a store by micro-batches, or kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from shelfwatch.operators.seen import KEPT_IF_BLANK, LATEST, SCHEMA, SeenStore

COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upsert_stream(observations: DataFrame, store: SeenStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Fold each micro-batch into the store. An upsert leaves first_seen_at alone, so a batch that is replayed after a failure changes nothing."""
    writer = observations.writeStream.foreachBatch(lambda batch, _: store.upsert(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_only(observations: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The first row of each key as it comes, with state for as long as rows may be late."""
    return observations.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


class FirstSeen(StatefulProcessor):
    """A key's row of the store as its state. A batch's rows of a key are looked at one by one, whatever their number and order."""

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", StructType([StructField(c, StringType()) for c in COLUMNS[1:]]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.held.get() if self.held.exists() else None
        now = dict(zip(COLUMNS[1:], old, strict=True)) if old is not None else dict.fromkeys(COLUMNS[1:], "")
        first, last, told = None, None, {}
        for r in rows:
            at = r[self.order]
            if first is None or at < first:
                first = at
                if old is None:
                    now["first_seen_at"] = r["first_seen_at"]
            if last is None or at >= last:
                last = at
                now |= {c: r[c] for c in LATEST}
            for c in KEPT_IF_BLANK:
                if r[c] and (c not in told or at >= told[c]):
                    told[c], now[c] = at, r[c]
        self.held.update(tuple(now[c] for c in COLUMNS[1:]))
        yield Row(hash=key[0], **now, known=old is not None)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.held.update(tuple(initialState[c] for c in COLUMNS[1:]))

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """State of more than one variable needs a store on the executors' disks; for queries that start from now on."""
    spark.conf.set(PROVIDER, ROCKS)


def first_seen_changes(observations: DataFrame, order: str = "pos", store: DataFrame | None = None) -> DataFrame:
    """The store's row of each key that a micro-batch has, as it stands after it, with known: was the key there before?

    observations have the store's columns, none of them null, and an order within each batch. There is no watermark: a
    late row is recorded as any other, and first_seen_at stays as first met. `store` is where the state begins. The last
    row of each key is what operators.seen.merged gives for the batches one after the other. Call keyed_state() before the query starts.
    """
    first = store.select(*COLUMNS).groupBy("hash") if store is not None else None
    return observations.groupBy("hash").transformWithState(FirstSeen(order), f"{SCHEMA}, known boolean", "Append", "None", initialState=first)
