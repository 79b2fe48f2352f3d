"""Quality classifier: a sparse ensemble of rules, compiled into column expressions.

Statistics of a text are column expressions over the whole text. Small trees are grown on a bounded sample of
labelled rows; each path from a root to a node is a rule, a conjunction of thresholds. A logistic model with an L1
penalty weighs the rules, most of them by zero, and what is left is one expression again: scoring is a projection in
the scan's own stage, for any number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import keyed_text

SAMPLE = 20_000
TREES, DEPTH, BINS, LEAST_ROWS = 40, 3, 32, 10
SEED = 17


def statistics(text: Column) -> dict[str, Column]:
    """What rules look at, by name. Ratios of an empty text are 0."""

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = count(r"\S+")
    some = F.greatest(words, F.lit(1.0))
    lines = F.split(text, "\n")
    return {
        "chars": F.length(text).cast("double"),
        "words": words,
        "word_length": F.length(text) / some,
        "upper": count(r"\p{Lu}") / chars,
        "letters": (F.length(text) - count(r"[^\p{L}]")) / chars,
        "digits": count(r"[0-9]") / chars,
        "stops": count(r"[.?](?=\s|$)") / some,
        "exclaims": count("!") / some,
        "symbols": count(r"[#$%&*@^~<>|=+_\\{}\[\]]") / some,
        "symbol_runs": count(r"[#$%&*!]{2,}") / some,
        "bars": count(r"\|") / some,
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "links": count(r"https?://|www\.|@[a-z]") / some,
        "twice": count(r"(?i)\b(\p{L}+)\W+\1\b") / some,
    }


@dataclass(frozen=True)
class Rule:
    """Holds where every (statistic, above, threshold) does: > threshold if above, else <=."""

    terms: tuple[tuple[int, bool, float], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, at in self.terms:
            out &= (x[:, f] > at) == above
        return out


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, columns: dict[str, Column]) -> Column:
        """The probability of label 1 as one expression."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for f, above, at in rule.terms:
                c = columns[self.names[f]]
                holds = holds & ((c > at) if above else (c <= at))
            total = total + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total += w * rule.of(x)
        return 1 / (1 + np.exp(-total))


def grow(binned: np.ndarray, edges: list[np.ndarray], y: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, terms: tuple, out: set) -> None:
    """Split the rows by the best of the features, by variance; every node but the root adds the rule of its path."""
    if terms:
        out.add(Rule(tuple(sorted(terms))))
    if depth == 0 or len(rows) < 2 * LEAST_ROWS or y[rows].min() == y[rows].max():
        return
    best, n, total = None, len(rows), y[rows].sum()
    for f in features:
        if not len(edges[f]):
            continue
        b = binned[rows, f]
        left_n = np.bincount(b, minlength=BINS + 1).cumsum()[: len(edges[f])]
        left_y = np.bincount(b, weights=y[rows], minlength=BINS + 1).cumsum()[: len(edges[f])]
        ok = (left_n >= LEAST_ROWS) & (n - left_n >= LEAST_ROWS)
        if not ok.any():
            continue
        gain = np.where(ok, left_y**2 / np.maximum(left_n, 1) + (total - left_y) ** 2 / np.maximum(n - left_n, 1), -1.0)
        k = int(gain.argmax())
        if gain[k] > total**2 / n + 1e-9 and (best is None or gain[k] > best[0]):
            best = gain[k], f, k
    if best is None:
        return
    _, f, k = best
    low = binned[rows, f] <= k
    for above, part in ((False, rows[low]), (True, rows[~low])):
        grow(binned, edges, y, part, features, depth - 1, (*terms, (int(f), above, float(edges[f][k]))), out)


def lasso(rules: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty and a free bias, by accelerated proximal gradient.

    Products with the rules, which are zeros and ones, are in their own precision: another would copy them each time.
    """
    n, p = rules.shape
    over_rules = lambda x: (rules @ x.astype(rules.dtype)).astype(np.float64)
    over_rows = lambda x: (x.astype(rules.dtype) @ rules).astype(np.float64)
    w, b = np.zeros(p), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, vb, t = w.copy(), b, 1.0
    x = np.random.default_rng(SEED).normal(size=p + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        r = over_rules(x[:p]) + x[p]
        x = np.append(over_rows(r), r.sum())
        norm = np.linalg.norm(x)
        x /= norm
    step = 4 * n / (norm * 1.05)
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(over_rules(v) + vb))) - y
        w2 = v - step * over_rows(g) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = vb - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Model:
    """Rules from bagged trees, then their weights; the penalty is that of the least loss on a fifth of the rows. With one class, or none, a constant."""
    n = len(y)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if n < 4 * LEAST_ROWS or y.min() == y.max():
        return Model(names, (), (), prior)
    rng = np.random.default_rng(SEED)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    found: set[Rule] = set()
    for _ in range(TREES):
        rows = rng.integers(0, n, n)
        features = np.sort(rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False))
        grow(binned, edges, y, rows, features, DEPTH, (), found)
    rules, seen = [], set()
    for r in sorted(found, key=lambda r: (len(r.terms), r.terms)):
        bits = np.packbits(r.of(x)).tobytes()
        if bits not in seen:
            seen.add(bits)
            rules.append(r)
    if not rules:
        return Model(names, (), (), prior)
    z = np.stack([r.of(x) for r in rules], axis=1).astype(np.float32)
    held = rng.random(n) < 0.2
    best = None
    for penalty in (0.02, 0.01, 0.005, 0.002, 0.001):
        w, b = lasso(z[~held], y[~held], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[held] @ w.astype(z.dtype) + b))), 1e-6, 1 - 1e-6)
        loss = -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)) if held.any() else penalty
        if best is None or loss < best[0] - 1e-4:
            best = loss, penalty
    w, b = lasso(z, y, best[1])
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Model(names, tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept), float(b))


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most `sample` labelled rows (those of the least hash of their id) outside the held-out quarter. Rows without a label 0 or 1 don't count; of several labels of one id the largest does."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(bucket(F.col("doc_id")) != 2)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = statistics(F.coalesce("text", F.lit("")))
    rows = keyed_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id")
    got = rows.select("doc_id", "y", *(c.alias(n) for n, c in stats.items())).orderBy(F.xxhash64("doc_id"), "doc_id", *stats).limit(2 * sample).toPandas()
    return fit(got[list(stats)].to_numpy("float64"), got["y"].to_numpy("float64"), tuple(stats))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) of every whole text.

    Null and empty texts are scored like any other, with statistics of 0; a null id's bucket is that of the empty
    string; repeated rows come out repeated; an empty table gives none. Without usable labels all scores are 0.5.
    """
    model = train(docs, labels, sample, id_col, text_col)
    stats = statistics(F.coalesce("text", F.lit("")))
    flat = keyed_text(docs, id_col, text_col).select("doc_id", *(c.alias(f"s_{n}") for n, c in stats.items() if any(model.names[f] == n for r in model.rules for f, _, _ in r.terms)))
    scored = flat.select("doc_id", (bucket(F.col("doc_id")) == 2).alias("held_out"), model.score({n: F.col(f"s_{n}") for n in stats}).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that score at least the threshold."""
    model = train(docs, labels, sample, id_col, text_col)
    stats = {n: c for n, c in statistics(F.coalesce(docs[text_col].cast("string"), F.lit(""))).items() if any(model.names[f] == n for r in model.rules for f, _, _ in r.terms)}
    if not stats:
        return docs.where(model.score({}) >= threshold)
    # The partition's number, which counts as nondeterministic, holds the filter above the projection: below it, each rule would compute its statistics anew.
    flat = docs.select(F.struct("*").alias("_row"), *(c.alias(f"_s_{n}") for n, c in stats.items()), F.spark_partition_id().alias("_part"))
    good = flat.where((F.col("_part") >= 0) & (model.score({n: F.col(f"_s_{n}") for n in stats}) >= threshold))
    return good.select("_row.*")
