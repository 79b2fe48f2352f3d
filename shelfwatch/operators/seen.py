"""The first-seen store, keyed by hash: buckets of Parquet files, of which an upsert adds to those of its keys only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "hash string, url string, title string, description string, first_seen_at string, shopify_updated_at string, roaster string, platform string"
LATEST = ("url", "title", "description")
KEPT = 8  # versions: a run reads the one that it began with
BUCKETS = 64
MOST_PARTS = 4  # of a bucket, before they are made one
KEPT_IF_BLANK = ("shopify_updated_at", "roaster", "platform")


def folded(rows: DataFrame, order: str = "pos") -> DataFrame:
    """A row for each key of rows in order: first_seen_at is the first one, url, title and description are the last ones, the others the last that isn't blank. Partial aggregation comes before the shuffle, so a hot key is a row a task."""
    last = [F.max_by(c, order).alias(c) for c in LATEST]
    filled = [F.coalesce(F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(order))), F.lit("")).alias(c) for c in KEPT_IF_BLANK]
    return rows.groupBy("hash").agg(*last, F.min_by("first_seen_at", order).alias("first_seen_at"), *filled)


def merged(store: DataFrame, batch: DataFrame, order: str = "pos") -> DataFrame:
    """The store after the batch's rows in order: first_seen_at stays as first set, the rest as folded() says. A key's rows of the batch are folded before the join."""
    new = folded(batch, order).select("hash", *(F.col(c).alias(f"n_{c}") for c in (*LATEST, "first_seen_at", *KEPT_IF_BLANK)))
    both = store.join(new, "hash", "full_outer")
    return both.select(
        "hash",
        *(F.coalesce(f"n_{c}", c).alias(c) for c in LATEST),
        F.coalesce("first_seen_at", "n_first_seen_at").alias("first_seen_at"),
        *(F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), c, F.lit("")).alias(c) for c in KEPT_IF_BLANK),
    )


def filled(snapshot: DataFrame, *further: str) -> DataFrame:
    """The store's columns; those that a snapshot lacks, and nulls, are blank. Further columns come along as they are."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return snapshot.select(*(F.coalesce(F.col(n), F.lit("")).alias(n) if n in snapshot.columns else F.lit("").alias(n) for n in names), *further)


class Conflict(Exception):
    """Another writer has committed the version meanwhile."""


class SeenStore:
    """A store below a path that Spark reads.

    data/part=P/bucket=B holds what one upsert has added to a bucket, a row for each key; parts stand in the order of
    their names. manifests/N.json says for version N which parts each bucket has; it is written aside and renamed, so a
    version is there as a whole or not at all, and a writer that lost against another one adds its part to the other's
    version. An upsert writes its own keys' rows and no others. Reading folds a bucket's parts; when it has more than
    MOST_PARTS they are made one, again for that bucket alone. The last KEPT versions stay readable.

    A path with snapshots v=N of an earlier layout is read, and taken over by the first upsert.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def version(self) -> int:
        """The latest version; 0 if there is none."""
        return max((int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int) -> dict:
        """{buckets: how many, parts: {bucket: [part, ...]}} of a version."""
        if not version:
            return {"buckets": self.buckets, "parts": {}}
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self._at("manifests", f"{version:08d}.json")), "UTF-8")
        return json.loads(text)

    def _commit(self, version: int, manifest: dict) -> None:
        aside, place = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"{version:08d}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(aside, place):
            self.fs.delete(aside, False)
            raise Conflict(version)

    def _snapshot(self) -> str | None:
        """The last snapshot of the earlier layout, if that is all there is."""
        done = [n for n in self._names() if n.startswith("v=") and self.fs.exists(self._at(n, "_SUCCESS"))]
        return f"{self.path}/{max(done, key=lambda n: int(n[2:]))}" if done and not self.version() else None

    def _rows(self, parts: dict[str, list[str]]) -> DataFrame:
        """The rows of these parts of these buckets, with part."""
        if not parts:
            return self.spark.createDataFrame([], f"{SCHEMA}, part string")
        paths = [f"{self.path}/data/part={p}/bucket={b}" for b, ps in parts.items() for p in ps]
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(f"{SCHEMA}, part string, bucket int").parquet(*paths)
        return filled(rows, "part")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The store, or only some of its buckets; columns that older files lack are blank."""
        if version is None and (old := self._snapshot()):
            return filled(self.spark.read.parquet(old))
        held = self.manifest(self.version() if version is None else version)["parts"]
        held = {b: ps for b, ps in held.items() if buckets is None or int(b) in buckets}
        single, several = ({b: ps for b, ps in held.items() if (len(ps) > 1) == many} for many in (False, True))
        rows = self._rows(single).drop("part")
        return rows.unionByName(folded(self._rows(several), "part")) if several else rows

    def bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64("hash"), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, version: int, n: int) -> tuple[str, list[str]]:
        """The name of a new part with these rows, and the buckets that it has."""
        part = f"{version:08d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket", self.bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/part={part}")
        return part, [x.removeprefix("bucket=") for x in self._names("data", f"part={part}") if x.startswith("bucket=")]

    def _add(self, rows: DataFrame) -> int:
        """A version with these rows, one for each key, as a further part of their buckets."""
        version = self.version()
        part, touched = self._write(rows, version + 1, self.manifest(version)["buckets"])
        while touched:
            held = self.manifest(version)
            parts = held["parts"] | {b: [*held["parts"].get(b, []), part] for b in touched}
            try:
                self._commit(version + 1, held | {"parts": parts})
                return version + 1
            except Conflict:
                version = self.version()
        return version

    def upsert(self, batch: DataFrame, order: str = "pos") -> int:
        """Add the batch's rows, in order; the version that has them. A batch that is added again changes nothing."""
        if old := self._snapshot():
            self._add(filled(self.spark.read.parquet(old)))
        version = self._add(folded(batch, order))
        self.compact()
        self.vacuum()
        return version

    def compact(self, most: int = MOST_PARTS) -> list[str]:
        """Make one part of those of each bucket that has more than so many; the buckets."""
        version = self.version()
        held = self.manifest(version)
        many = {b: ps for b, ps in held["parts"].items() if len(ps) > most}
        if many:
            part, there = self._write(folded(self._rows(many), "part"), version + 1, held["buckets"])
            try:
                self._commit(version + 1, held | {"parts": held["parts"] | {b: [part] for b in there}})
            except Conflict:
                return []  # the next upsert tries again
        return sorted(many, key=int)

    def vacuum(self) -> None:
        """Drop versions before the last KEPT, and parts older than the last version that none of the others has: a later one may be a writer's that has still to commit."""
        last = self.version()
        kept = [v for v in range(max(1, last - KEPT + 1), last + 1)]
        used = {p for v in kept for ps in self.manifest(v)["parts"].values() for p in ps}
        for n in self._names("manifests"):
            if n.endswith(".json") and n[:-5].isdigit() and int(n[:-5]) < kept[0]:
                self.fs.delete(self._at("manifests", n), False)
        for n in self._names("data"):
            if (p := n.removeprefix("part=")) not in used and int(p[:8]) < kept[0]:
                self.fs.delete(self._at("data", n), True)
