"""Many keywords at once: one Aho-Corasick pass over each text, whatever the number of keywords.

Keywords are a table, each for one source or, where the source is null, for all. They are sent to the tasks in automata of at most
AT_ONCE keywords; a larger table takes several, one after the other within the same scan. A worker builds an automaton once.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AT_ONCE = 100_000
_BUILT: dict[str, object] = {}


def automaton(name: str, words: dict[str, set[str] | None]):
    """Of this worker, by name; keywords with the sources that they are for, None for all."""
    if name not in _BUILT:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word, sources in words.items():
            made.add_word(word, (word, sources))
        made.make_automaton()
        while len(_BUILT) >= 4:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[name] = made
    return _BUILT[name]


def _found(spark, words: dict[str, set[str] | None], text: Column, source: Column) -> Column:
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: pd.Series, sources: pd.Series) -> pd.Series:
        machine = automaton(name, sent.value)
        return pd.Series([sorted({w for _, (w, of) in machine.iter(t) if of is None or s in of}) if t else [] for t, s in zip(texts, sources, strict=True)])

    return found(text, source)


def with_hits(df: DataFrame, text: Column, source: Column, keywords: DataFrame, name: str = "hits") -> DataFrame:
    """df with an array of the keywords that a row's text has and that are for its source, sorted, each once; keywords: (source, keyword).

    Keywords are sought as they are, parts of words included; null and empty ones don't count. A null text has none.
    """
    spark, out = df.sparkSession, F.array().cast("array<string>")
    known = keywords.select(F.col("source").cast("string").alias("source"), F.col("keyword").cast("string").alias("keyword")).where("keyword <> ''")
    by_word = known.groupBy("keyword").agg(F.collect_set("source").alias("sources"), F.count_if(F.col("source").isNull()).alias("everywhere"))
    block: dict[str, set[str] | None] = {}
    for r in by_word.toLocalIterator():
        block[r.keyword] = None if r.everywhere else set(r.sources)
        if len(block) == AT_ONCE:
            out, block = F.array_union(out, _found(spark, block, text, source)), {}
    if block:
        out = F.array_union(out, _found(spark, block, text, source))
    return df.withColumn(name, F.array_sort(out))
