"""Near-duplicates of word-shingle sets by a chosen-path similarity join.

Equal sets are one class first, whatever their number. Each class has 64 minwise tokens. A class of whose token pairs
no other class has one ends there: it has no partner. A tree branches the others by tokens: a node picks a
coordinate, sometimes a second one (1.25 on average, 1 over the similarity sought), and sends each class to the child
of its token there; classes of similar sets share paths. Levels are DataFrame rows (node, class); nodes of one class
end, nodes of up to NODE classes are leaves. Trees are repeated to the target recall, which the branching process
gives in closed form for each number of coordinates that two signatures may agree in: all trees share these, so the
recall is the average over that number.

Nothing lists the pairs of a group. In every node each class is first compared with the node's pivot, a class that
the node draws: a group of thousands of near copies hangs together after that, for it has other pivots in other
nodes. FIRST_PIVOTS of its pivots come first, the others only where a class doesn't hang together with them yet. A node
over NODE classes whose classes all hang together ends, else it branches on, down to LAST_DEPTH. Then the classes of
a leaf that don't hang together yet are compared exhaustively, by signature and what is left on the full sets; what
is still large at LAST_DEPTH is cut into blocks, in which the classes outside the pivot's component meet all. A block gives
no more links than connect it. Components are found by min-label propagation with pointer jumping over the links in
the shared folder; further links are taken between components.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import Workspace, batch_of, grouped, groups_of, keyed_text, row_count, text_hash, without

COORDINATES = 64
NODE = 4096
FIRST_DEPTH, MOST_DEPTH, LAST_DEPTH = 3, 7, 11
SECOND_BRANCH = 4  # one node in so many picks a second coordinate
RECALL = 0.9999  # of a pair that is similar enough, in nodes down to MOST_DEPTH
NO_PARTNER = 1e-5  # the chance that a pair of just the similarity sought shares none of the probes
FIRST_PIVOTS = 4  # of each class, before the others are asked for
SALT = 512  # a pivot's set is read once for about so many comparisons
BLOCK_BYTES = 64 << 20
KEPT_WORDS = 200_000
FEATURES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("sig", pa.binary())])
ROWS = pa.schema([("path", pa.int64()), ("cid", pa.int64())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
CHOSEN = pa.schema([("block", pa.int64()), ("cid", pa.int64()), ("label", pa.int64())])


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def shingles(text: str, k: int, words: WordHashes) -> np.ndarray:
    """Distinct hashes of the text's runs of k words, sorted; of all its words if they are fewer; A-Z count as a-z, words end at ASCII blanks."""
    h = np.fromiter(map(words.__getitem__, text.encode().lower().split()), np.uint64)
    if not len(h):
        return h
    width = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def class_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minwise tokens of 32 bits for each non-empty set."""
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for i, f in enumerate(FACTORS):
            x = flat * f
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            out[:, i] = np.minimum.reduceat(x, at) >> np.uint64(16) & np.uint64(0xFFFFFFFF)
    return out


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, cid (64-bit hash of the set, null if empty), n (set size), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, texts in groups_of(batch, 1, 1_000_000):
                sets = [shingles(t, k, words) for t in texts]
                some = [s for s in sets if len(s)]
                sig = iter(signatures(some) if some else ())
                rows = [(class_id(s), len(s), next(sig).tobytes()) if len(s) else (None, 0, None) for s in sets]
                yield batch_of(FEATURES, (ids[a:b], hashes[a:b], *zip(*rows, strict=True)))

    return docs.select("doc_id", "text", text_hash(docs["text"]).alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, cid long, n long, sig binary")


def step(rows: np.ndarray, paths: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level down: (row, path) of the children that each (row, path) goes to."""
    with np.errstate(over="ignore"):
        pick = mixed(paths + np.uint64(0xA5A5A5A5))
        c = (pick % np.uint64(COORDINATES)).astype(np.int64)
        second = (pick >> np.uint64(40)) % np.uint64(SECOND_BRANCH) == 0
        d = (c + 1 + ((pick >> np.uint64(20)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
        rows2, paths2, coords = np.concatenate([rows, rows[second]]), np.concatenate([paths, paths[second]]), np.concatenate([c, d[second]])
        token = sig[rows2, coords].astype(np.uint64) << np.uint64(8) | coords.astype(np.uint64)
        return rows2, mixed(paths2 * np.uint64(0x9E3779B97F4A7C15) + mixed(token + np.uint64(1)))


def survival(depth: int, similarity: float) -> float:
    """How likely two sets share a path of this depth in one tree."""
    p = 1.0
    for _ in range(depth):
        x = 1 - similarity * p
        p = 1 - ((1 - 1 / SECOND_BRANCH) * x + x * x / SECOND_BRANCH)
    return p


def trees_for(recall: float, similarity: float) -> int:
    """How many trees bring a pair of this similarity together with this chance, given that all of them draw from the same coordinates."""
    agree = np.arange(COORDINATES + 1)
    chance = np.array([math.comb(COORDINATES, a) * similarity**a * (1 - similarity) ** (COORDINATES - a) for a in agree.tolist()])
    apart = 1 - np.array([survival(MOST_DEPTH, a / COORDINATES) for a in agree.tolist()])
    if chance[apart >= 1].sum() >= 1 - recall:
        raise ValueError(f"{COORDINATES} coordinates are too few for a recall of {recall} at similarity {similarity}")
    missed = lambda trees: float((chance * apart**trees).sum())
    most = 1
    while missed(most) > 1 - recall:
        most *= 2
    return bisect.bisect_left(range(most + 1), True, 1, key=lambda trees: missed(trees) <= 1 - recall)


def sig_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def first_rows(classes: DataFrame, trees: int) -> DataFrame:
    """(path, cid) of every class at FIRST_DEPTH in all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mixed(np.arange(1, trees + 1, dtype=np.uint64))
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                batch = big.slice(at, 4096)
                sig, cid = sig_of(batch.column(1)), batch.column(0).to_numpy()
                rows, paths = np.repeat(np.arange(len(cid)), trees), np.tile(roots, len(cid))
                for _ in range(FIRST_DEPTH):
                    rows, paths = step(rows, paths, sig)
                yield batch_of(ROWS, (signed(paths), cid[rows]))

    return classes.select("cid", "sig").mapInArrow(run, "path long, cid long")


def next_rows(rows: DataFrame, levels: int) -> DataFrame:
    """Children, so many levels down, of rows (path, cid, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig, cid = sig_of(batch.column(2)), batch.column(1).to_numpy()
                at, paths = np.arange(len(cid)), batch.column(0).to_numpy().view(np.uint64)
                for _ in range(levels):
                    at, paths = step(at, paths, sig)
                yield batch_of(ROWS, (signed(paths), cid[at]))

    return rows.select("path", "cid", "sig").mapInArrow(run, "path long, cid long")


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def fair(na, nb, sa: np.ndarray, sb: np.ndarray, similarity: float) -> np.ndarray:
    """Can such sets be similar enough? By size surely, by signature but for chances below one in a million."""
    least = COORDINATES * similarity - 5 * math.sqrt(COORDINATES * similarity * (1 - similarity))
    return (np.minimum(na, nb) >= similarity * np.maximum(na, nb)) & (agreeing(sa, sb) >= least)


def with_partners(classes: DataFrame, similarity: float) -> DataFrame:
    """classes without those that share none of their probes, pairs of minwise tokens, with another one."""
    probes = math.ceil(math.log(NO_PARTNER) / math.log(1 - similarity**2)) if similarity < 1 else 1
    if 2 * probes > COORDINATES:
        return classes
    tokens = [F.xxhash64(F.lit(i), F.substring("sig", 8 * i + 1, 8)) for i in range(probes)]
    held = classes.select("cid", F.explode(F.array(*tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.min("cid").alias("cid"))
    alone = held.where("holders = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") == probes)
    return classes.join(alone, "cid", "left_anti")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(path, size, pivot) of the nodes that hold at least two classes; the pivot is the class that is least when the path flips its bits."""
    least = F.min(F.col("cid").bitwiseXOR(F.col("path")))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), least.alias("pivot")).where("size > 1").withColumn("pivot", F.col("pivot").bitwiseXOR(F.col("path")))


def star(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, salt): each class b with the pivots a of its nodes, or `most` of these, once; salt deals a pivot's comparisons to several groups. The least pivots come first, as many classes share them."""
    pairs = rows.where("cid <> pivot").groupBy(F.col("pivot").alias("a"), F.col("cid").alias("b")).agg(F.max("size").alias("size"))
    if most:
        some = pairs.groupBy("b").agg(F.slice(F.array_sort(F.collect_list(F.struct("a", "size"))), 1, most).alias("pivots"))
        pairs = some.select("b", F.inline("pivots"))
    return pairs.select("a", "b", F.pmod(F.xxhash64("b"), 1 + F.floor(F.col("size") / SALT)).alias("salt"))


def texts_of(docs: DataFrame, classes: DataFrame, cids: DataFrame) -> DataFrame:
    """(want, text) of the classes in cids, by the id and the text's hash of a document of each: an id that many texts share, or none, finds its own text only."""
    wanted = cids.distinct().join(classes.select("cid", "rep", "rep_hash"), "cid")
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"]) & (text_hash(docs["text"]) == wanted["rep_hash"])).select(F.col("cid").alias("want"), "text")


def full_sets(docs: DataFrame, classes: DataFrame, cids: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) of the classes in cids, made again from one document each."""
    texts = texts_of(docs, classes, cids)
    made = pa.schema([("cid", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            want = batch.column(0).to_pylist()
            for a, b, ts in groups_of(batch, 1, 1_000_000):
                rows = [(w, s.tobytes()) for w, s in zip(want[a:b], (shingles(t, k, words) for t in ts), strict=True) if len(s) and class_id(s) == w]
                if rows:
                    yield batch_of(made, zip(*rows, strict=True))

    return texts.mapInArrow(sets, "cid long, shingles binary").dropDuplicates(["cid"])


def set_at(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.uint64)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, salt) whose full sets are similar enough. Sorted by (a, salt), the set of a comes first and alone is held while those of its partners go by."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for i, k in enumerate(zip(a, salt, strict=True)):
                own = set_at(batch.column(3), i)
                if b[i] is None:
                    key, pivot = k, own.copy()
                elif k == key and 100 * min(len(own), len(pivot)) >= percent * max(len(own), len(pivot)):
                    at = np.searchsorted(pivot, own)
                    same = int((pivot[np.minimum(at, len(pivot) - 1)] == own).sum())
                    if 100 * same >= percent * (len(own) + len(pivot) - same):
                        found.append((a[i], b[i]))
            if found:
                yield batch_of(PAIRS, zip(*found, strict=True))

    heads = pairs.select("a", "salt").distinct().join(sets.withColumnRenamed("cid", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    others = pairs.join(sets.withColumnRenamed("cid", "b"), "b").select("a", "salt", "b", "shingles")
    rows = heads.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(check, "a long, b long").distinct()


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(cid, label) of every class with a link; label is the least class of its component. Labels flow along links and then twice as far each round."""
    both = ws.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = ws.save(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "cid"), "cid").select("cid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("cid").alias("label"), F.col("label").alias("further"))
        moved = ws.save(lower.join(over, "label", "left").select("cid", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "moved")
        done = moved.where("label <> old").isEmpty()
        labels = ws.save(moved.select("cid", "label"), "labels")
        if done:
            ws.drop("both", "moved")
            return labels


def relabelled(ws: Workspace, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels after further links, which are first taken between labels: what hangs together already counts as one class."""
    if labels is None:
        return components(ws, links)
    ends = links.select("a", "b")
    for end in ("a", "b"):
        name = labels.select(F.col("cid").alias(end), F.col("label").alias("name"))
        ends = ends.join(name, end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    ends = ws.save(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ends")
    if ends.isEmpty():
        return labels
    before = ws.save(labels, "before")  # components() writes labels of its own
    top = components(ws, ends)
    moved = before.join(top.select(F.col("cid").alias("label"), F.col("label").alias("top")), "label", "left").select("cid", F.coalesce("top", "label").alias("label"))
    # A class that only now has a link has no row yet.
    return ws.save(moved.unionByName(top.join(before.select("cid"), "cid", "left_anti").select("cid", "label")), "relabelled")


def labelled_rows(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows and the label of each class, itself where it has none."""
    if labels is None:
        return rows.withColumn("label", F.col("cid"))
    return rows.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def apart(rows: DataFrame) -> DataFrame:
    """Those labelled rows whose node holds several labels."""
    nodes = rows.groupBy("path").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("path")
    return rows.join(nodes, "path", "left_semi")


def blocks_of(rows: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, block, cid, label, kind, home) of the leaves that hold several components; kind is 0, or 1 for a host and 2 for a guest.

    A leaf of up to NODE classes and BLOCK_BYTES of sets is one block. In a larger one the classes outside the pivot's
    component, its guests, are to meet all others, and its hosts, those of that component, each other no more: both
    are cut into parts of about that size, and a block is two parts that have to meet.
    """
    marked = apart(labelled_rows(rows, labels)).join(classes.select("cid", "n"), "cid")
    root = labels.select(F.col("cid").alias("pivot"), F.col("label").alias("pivot_label"))
    marked = marked.join(root, "pivot", "left").withColumn("guest", F.col("label") != F.coalesce("pivot_label", "pivot"))
    per = lambda what: F.ceil(F.greatest(F.count_if(what) / NODE, F.coalesce(F.sum(F.when(what, F.col("n") * 8)), F.lit(0)) / BLOCK_BYTES)).cast("long")
    nodes = marked.groupBy("path").agg(per(F.lit(True)).alias("parts"), per(F.col("guest")).alias("guests"), per(~F.col("guest")).alias("hosts"))
    rows = marked.join(nodes, "path").withColumn("kind", F.when(F.col("parts") <= 1, 0).when(F.col("guest"), 2).otherwise(1))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("cid"), F.greatest(F.lit(1), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("hosts")))))
    block = lambda kind, x, y: F.lit(kind << 40) + F.shiftleft(x, 20) + y
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), F.col(n)), lambda x: x < F.col(n))
    home = F.col("home")
    with_hosts, as_host = F.transform(upto("hosts"), lambda c: block(1, c, home)), F.transform(upto("guests"), lambda g: block(1, home, g))
    with_guests = F.transform(upto("guests"), lambda g: block(2, F.least(g, home), F.greatest(g, home)))
    where = F.when(F.col("kind") == 0, F.array(F.lit(0).cast("long"))).when(F.col("kind") == 2, F.concat(with_hosts, with_guests)).otherwise(as_host)
    return rows.select("path", F.explode(where).alias("block"), "cid", "label", "kind", "home")


def to_compare(label: np.ndarray) -> np.ndarray:
    """The rows that have to look for partners: all but those of the most frequent label."""
    names, at, count = np.unique(label, return_inverse=True, return_counts=True)
    return np.flatnonzero(at != count.argmax())


def meeting(t: pa.Table, similarity: float) -> list[np.ndarray]:
    """The rows of a block (label, kind, home, n, sig in its third column and on) that have another one with which they may be similar but aren't connected, in groups: no such pair is in two of them."""
    label, kind, home, n = (t.column(c).to_numpy() for c in range(3, 7))
    sig, group, within = sig_of(t.column(7).combine_chunks()), np.arange(len(label)), int(t.column(1)[0].as_py())
    two_parts = within >> 40 == 2 and (within >> 20) % (1 << 20) != within % (1 << 20)
    seekers = to_compare(label)
    step_by = max(1, (16 << 20) // (len(label) * COORDINATES))
    for at in range(0, len(seekers), step_by):
        i = seekers[at : at + step_by]
        ok = label[i, None] != label
        if within >> 40 == 1:
            ok &= kind[i, None] != kind
        elif two_parts:
            ok &= home[i, None] != home
        ok &= fair(n[i, None], n, sig[i, None, :], sig, similarity)
        for r in np.flatnonzero(ok.any(axis=1)).tolist():
            mine = group[i[r]]
            for other in np.unique(group[ok[r]]).tolist():
                if other != mine:
                    group[group == other] = mine
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order])) + 1
    return [rows for rows in np.split(order, cuts) if len(rows) > 1]


def joined_groups(ws: Workspace, chosen: DataFrame, classes: DataFrame) -> DataFrame:
    """chosen (block, cid, label) with blocks that share classes as one, where what hangs together so has up to NODE classes and BLOCK_BYTES of sets."""
    own = Workspace(ws.spark, "groups")  # components() writes labels of its own
    heads = chosen.groupBy("block").agg(F.min("cid").alias("b"))
    chains = own.save(chosen.join(heads, "block").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct(), "chains")
    whole = components(own, chains).withColumnRenamed("label", "whole").join(classes.select("cid", "n"), "cid")
    fits = whole.groupBy("whole").agg(F.count(F.lit(1)).alias("held"), (8 * F.sum("n")).alias("bytes")).where((F.col("held") <= NODE) & (F.col("bytes") <= BLOCK_BYTES))
    of_class = whole.join(fits, "whole", "left_semi").select("cid", "whole")
    joined = chosen.join(of_class, "cid", "left").select(F.coalesce("whole", "block").alias("block"), "cid", "label").distinct()
    joined = ws.save(joined, "joined")
    own.drop("chains", "labels")
    return joined


def other_links(ws: Workspace, leaf: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes that share a leaf but no component, compared exhaustively on their full sets.

    First the classes that have anyone to be compared with are told, in the groups that hang together by such pairs; groups of
    several trees' leaves that share a class are one from there on, so its set is sent once, unless that one is larger than a leaf. Then their sets come to the blocks. Of a block's links only those that connect what it hasn't connected
    yet are given, so their number is below its rows'.
    """
    spark, similarity = leaf.sparkSession, percent / 100
    tasks = max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ws.save(blocks_of(leaf, labels, classes), "blocks").join(classes.select("cid", "n", "sig"), "cid")
    rows = rows.select("path", "block", "cid", "label", "kind", "home", "n", "sig").repartition(tasks, "path", "block").sortWithinPartitions("path", "block", "cid")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 2):
            if t.num_rows > 1 and (groups := meeting(t, similarity)):
                at = np.concatenate(groups)
                cid, label = t.column(2).to_numpy()[at], t.column(3).to_numpy()[at]
                ends = np.cumsum([len(g) for g in groups])
                block = np.repeat([class_id(c) for c in np.split(cid, ends[:-1])], np.diff(ends, prepend=0))
                yield batch_of(CHOSEN, (block, cid, label))

    chosen = ws.save(rows.mapInArrow(members, "block long, cid long, label long").dropDuplicates(["block", "cid"]), "chosen")
    whole = joined_groups(ws, chosen, classes).join(sets, "cid").select("block", "cid", "label", "shingles").repartition(tasks, "block").sortWithinPartitions("block", "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 1):
            cid, part = t.column(1).to_numpy(), t.column(2).to_numpy().copy()
            each = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(3)]
            n, values = np.array([len(x) for x in each]), np.unique(np.concatenate(each), return_inverse=True)[1]
            first, seen, found = np.concatenate([[0], np.cumsum(n)[:-1]]), np.zeros(int(values.max()) + 1, bool), []
            for i in to_compare(part).tolist():
                mine = values[first[i] : first[i] + n[i]]
                seen[mine] = True
                same = np.add.reduceat(seen[values], first, dtype=np.int64)
                seen[mine] = False
                for j in np.flatnonzero((100 * same >= percent * (n[i] + n - same)) & (part != part[i])).tolist():
                    if part[j] != part[i]:
                        found.append((int(cid[i]), int(cid[j])))
                        part[part == part[j]] = part[i]
            if found:
                yield batch_of(PAIRS, zip(*found, strict=True))

    return whole.mapInArrow(compare, "a long, b long").distinct()


def classes_of(feats: DataFrame) -> DataFrame:
    """(cid, rep, rep_hash, n, sig) of features: each set once, with the smallest doc_id that has it and that row's text_hash; rep is null where no row of the set has an id."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    held = feats.where("cid is not null").groupBy("cid").agg(least.alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return held.select("cid", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_hash"), "n", "sig")


def links_of(ws: Workspace, docs: DataFrame, classes: DataFrame, k: int, percent: int, recall: float) -> DataFrame:
    """(cid, label) of the classes that are linked: pivots first, from the largest nodes on, then what they leave apart."""
    similarity = percent / 100
    some = ws.save(with_partners(classes, similarity), "some")
    rows, depth, leaf = ws.save(first_rows(some, trees_for(recall, similarity)), "rows"), FIRST_DEPTH, None
    labels = sets = None

    def connect(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return relabelled(ws, labels, ws.save(confirmed(pairs, sets, percent), "links"))

    while True:
        nodes = ws.save(nodes_of(rows), "nodes")
        held = ws.save(rows.join(nodes, "path").select("path", "cid", "pivot", "size"), f"held{depth}")
        if sets is None:  # deeper nodes hold no further classes, so the texts are shuffled once
            sets = ws.save(full_sets(docs, some, held.select("cid"), k), "sets")
        small, large = held.where(F.col("size") <= NODE), held.where(F.col("size") > NODE)
        leaf = small if leaf is None else leaf.unionByName(small)
        if large.isEmpty():
            break
        labels = connect(star(large), sets)
        large = ws.save(apart(labelled_rows(large, labels)).drop("label"), f"large{depth}")
        if depth >= LAST_DEPTH:
            leaf = leaf.unionByName(large)
            break
        levels = min(2, LAST_DEPTH - depth)
        rows, depth = ws.save(next_rows(large.join(some.select("cid", "sig"), "cid"), levels), "rows"), depth + levels
    ws.drop("rows", "nodes")
    first = ws.save(star(leaf, FIRST_PIVOTS), "star")
    labels = connect(first, sets)
    # The other pivots, for classes that don't hang together with them yet.
    of_pivot = labels.select(F.col("cid").alias("pivot"), F.col("label").alias("pivot_label"))
    rest = labelled_rows(leaf, labels).join(of_pivot, "pivot", "left").where(F.col("label") != F.coalesce("pivot_label", "pivot"))
    labels = connect(star(rest).join(first.select("a", "b"), ["a", "b"], "left_anti"), sets)
    labels = relabelled(ws, labels, ws.save(other_links(ws, leaf, labels, some, sets, percent), "other_links"))
    ws.drop("blocks", "chosen", "joined", "sets", "some", "star", "links", "ends", "before", *(f"{x}{d}" for x in ("held", "large") for d in range(LAST_DEPTH + 1)))
    return labels


def decisions(docs: DataFrame, shingle_words: int, percent: int, recall: float, id_col: str, text_col: str) -> DataFrame:
    """The rows of cluster() with the hash of their text: rows that agree in both that and doc_id are decided alike."""
    ws = Workspace(docs.sparkSession, "neardup")
    docs = keyed_text(docs, id_col, text_col)
    feats = ws.save(features(docs, shingle_words), "features")
    classes = ws.save(classes_of(feats), "classes")
    labels = links_of(ws, docs, classes, shingle_words, percent, recall)
    labelled = classes.select("cid", "rep").join(labels, "cid")
    least = labelled.groupBy("label").agg(F.min("rep").alias("least"))
    linked = ws.save(labelled.join(least, "label").select("cid", "least"), "linked")
    of_class = classes.select("cid", "rep").join(linked, "cid", "left").select("cid", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("rep")).alias("component_id"))
    out = feats.select("doc_id", "text_hash", "cid", F.col("n").alias("n_shingles")).join(of_class, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def cluster(docs: DataFrame, shingle_words: int = 5, percent: int = 80, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Links are sets with 100 * intersection >= percent * union; component_id is the smallest doc_id among the linked
    texts, the row's own included; kept is doc_id = component_id. Null and empty texts, and those of blanks, have no
    shingles and no link. Rows with equal sets are linked however many they are; repeated ids are kept together.
    Null ids count as largest: a component of null ids only has a null component_id and keeps its rows, else they go.
    Two different sets are taken as equal if a 64-bit hash is the same. An empty table gives none.
    """
    return decisions(docs, shingle_words, percent, recall, id_col, text_col).drop("text_hash")


def keep_first(docs: DataFrame, shingle_words: int = 5, percent: int = 80, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are not kept: of each component those of the smallest doc_id stay. Rows are decided one by one, whatever others have their id."""
    return without(docs, decisions(docs, shingle_words, percent, recall, id_col, text_col).where("not kept"), id_col, text_col)
