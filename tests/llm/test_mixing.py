"""Source mixing against a plain version that draws the same numbers, and against what rounding promises."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import mixing
from shelfwatch.llm.queries import QUERIES

SCHEMA = "key string, doc_id long, text string, source string, size int, target string, unit int"


def frame(spark, rows):
    return spark.createDataFrame([("k", i, t, s, 5, "t", 6) for i, t, s in rows], SCHEMA)


def count(text):
    n, inside = 0, False
    for c in text or "":
        space = c in mixing.SPACE
        n, inside = n + (not space and not inside), not space
    return n


def shares(totals):
    """Targets by source, resharing what is above three times a source's size."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(totals.values()) - sum(fixed.values())
        level = rest / sum(weight[x] for x in free)
        told = {s: weight[s] * level for s in free}
        above = {s: 3.0 * totals[s] for s in free if told[s] >= 3 * totals[s]}
        if not above:
            return fixed | told
        fixed |= above
        if len(fixed) == len(names):
            return fixed


def rounded(units, level, draw):
    """full or not of each (size, mass), by groups of 64."""
    residuals, out = [], {}
    for block in range(0, len(units), 64):
        carry, mass = block, units[block][1]
        for j in range(block + 1, min(block + 64, len(units))):
            size, (x_size, x) = units[carry][0], units[j]
            if mass <= 0 or mass >= size:
                out[carry], carry, mass = mass > 0, j, x
            elif x <= 0 or x >= x_size:
                out[j] = x > 0
            else:
                up, down = min(size - mass, x), min(mass, x_size - x)
                if draw(level, block // 64, j - block) * (up + down) < down:
                    if size - mass <= x:
                        out[carry], carry, mass = True, j, x - (size - mass)
                    else:
                        out[j], mass = False, mass + x
                elif mass <= x_size - x:
                    out[carry], carry, mass = False, j, x + mass
                else:
                    out[j], mass = True, mass - (x_size - x)
        residuals.append((carry, units[carry][0], mass))
    if len(residuals) == 1:
        at, size, mass = residuals[0]
        out[at] = draw() * size < mass
    else:
        upper = rounded([(s, m) for _, s, m in residuals], level + 1, draw)
        out |= {at: upper[k] for k, (at, _, _) in enumerate(residuals)}
    return out


def drawn(spark, source, most):
    """The numbers that the operator draws for a source."""
    key = ">" if source is None else "=" + source
    rows = spark.range(3).selectExpr("cast(id as int) level").join(spark.range(1 + most // 64).withColumnRenamed("id", "block")).join(spark.range(64).selectExpr("cast(id as int) at"))
    got = {(r.level, r.block, r.at): r.u for level in range(3) for r in rows.where(f"level = {level}").select("level", "block", "at", mixing.draw(0, level, F.lit(key), F.col("block"), F.col("at")).alias("u")).collect()}
    got[()] = spark.range(1).select(mixing.draw(0, -1, F.lit(key)).alias("u")).head()[0]
    return lambda *place: got[place]


def brute(spark, rows):
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((-count(t), i is not None, i or 0))
    totals = {s: -sum(x[0] for x in xs) for s, xs in by.items()}
    targets, out = shares(totals), []
    for s, xs in by.items():
        rate = targets[s] / totals[s] if totals[s] else 0.0
        xs.sort()
        full = rounded([(-n, -n * (rate - int(rate))) for n, _, _ in xs], 0, drawn(spark, s, len(xs)))
        out += [(i if known else None, -n, totals[s], -n * (int(rate) + full[k])) for k, (n, known, i) in enumerate(xs)]
    return targets, totals, out


def check(spark, rows, parts=4):
    got = mixing.mix(frame(spark, rows).repartition(parts)).collect()
    targets, totals, want = brute(spark, rows)
    assert sorted(((r.doc_id, r["size"], r.source_size, r.taken) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in targets.values()})
    by = defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source_size] += r.taken
        largest[r.source_size] = max(largest[r.source_size], r["size"])
    if len(set(totals.values())) == len(totals):
        assert all(abs(by[totals[s]] - targets[s]) <= largest[totals[s]] for s in totals)
    return got


def texts(n, seed, source):
    return [(seed * 10**6 + k, "w x \t " * ((k * 7919 + seed) % 23) + ("é\n" if k % 5 else ""), source) for k in range(n)]


def test_against_plain(spark):
    rows = texts(300, 1, "a") + texts(70, 2, "b") + texts(64, 3, "ü") + texts(5, 4, None) + texts(1, 5, "z") + [(1, None, "empty"), (2, " \n", "empty")]
    first = check(spark, rows, 3)
    assert sorted(map(tuple, check(spark, rows[::-1], 5))) == sorted(map(tuple, first))


def test_three_levels(spark):
    check(spark, texts(4200, 1, "hot") + texts(3, 2, "small"))


def test_repeated_null_and_long(spark):
    check(spark, [(7, "one two", "a")] * 200 + [(None, "no id", "a")] * 30 + [(None, None, None)] + [(8, "long " * 100_000, "b")])
    check(spark, [(1, "alone", None)])


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, "", None)]])
def test_nothing_to_share(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * len(rows)


def test_unbiased(spark):
    """Over many draws each unit is full as often as its mass says, and the sum of the masses stays."""
    n, sizes = 2000, [1, 2, 3, 5, 8, 13, 21]
    units = spark.range(n).select(F.col("id").cast("string").alias("key"), F.posexplode(F.array(*map(F.lit, sizes))).alias("idx", "size"))
    units = units.select("key", F.col("idx").cast("long").alias("idx"), F.struct(F.col("size").cast("long").alias("size"), (F.col("size") * 0.3).alias("mass")).alias("unit"))
    full, left = [0.0] * len(sizes), []
    for r in mixing.folded(units, ["key"], 0, 1).select("rest").collect():
        done = sum(sizes[x["at"]] for x in r.rest.out if x["full"])
        left.append(done + r.rest.mass)
        for x in r.rest.out:
            full[x["at"]] += x["full"]
        full[r.rest["at"]] += r.rest.mass / r.rest["size"]
    assert all(abs(x - 0.3 * sum(sizes)) < 1e-9 for x in left)
    assert all(abs(x / n - 0.3) < 0.05 for x in full)


def test_query(spark, sf):
    got = QUERIES["op12_source_mix"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.taken) for r in got.collect()) == sorted(brute(spark, [tuple(d) for d in docs])[2])
