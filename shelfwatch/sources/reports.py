"""Report files as rows, and files named after runs and sources."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.functions import urls
from shelfwatch.sources import named_files

DIGESTS = ("z-digest", "z-new-digest", "z-roaster-digest", "digest", "new-digest", "roaster-digest")


def file_name(run_id: str, name: Column, kind: str | None = None, ext: str = "md") -> Column:
    stem = F.concat_ws("-", F.lit(run_id), urls.slug(name))
    return F.concat_ws(".", stem, *([F.lit(kind)] if kind else []), F.lit(ext))


def readable(files: DataFrame, run_id: str) -> DataFrame:
    """(file_name, text) of a run's reports among files (file_name, value), without digests; blank ones are left out."""
    rows = files.select("file_name", F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))
    return rows.where(F.col("file_name").startswith(f"{run_id}-") & ~F.col("file_name").isin([f"{run_id}-{d}.md" for d in DIGESTS]) & (F.col("text") != ""))


def scan(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """The readable() reports of a folder."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"{run_id}-*.md").text(folder)
    return readable(files.select(F.col("_metadata.file_name").alias("file_name"), "value"), run_id)


def write(reports: DataFrame, folder: str) -> None:
    """(file_name, text) as files of just these names, replacing earlier ones. Executors write them, in a folder that they share with the driver."""
    named_files.write(reports, folder)


@F.pandas_udf(T.StringType())
def pretty_json(bodies: pd.Series) -> pd.Series:
    """A JSON body, indented; null if it is none."""

    def shown(s):
        try:
            return json.dumps(json.loads(s), indent=2, ensure_ascii=True)
        except (TypeError, ValueError):
            return None

    return bodies.map(shown)


def assets(responses: DataFrame, run_id: str, raw: bool, pretty: bool) -> DataFrame:
    """(file_name, text) of captured JSON responses (source, pos, body) as they came or indented, a file for each page; what is no JSON has no indented file."""
    page = F.concat(F.lit("page"), F.col("pos").cast("string"))
    named = lambda kind: F.concat(F.concat_ws("-", F.lit(run_id), urls.slug(F.col("source"))), F.lit(f".products.{kind}."), page, F.lit(".json"))
    kinds = [F.struct(named(k).alias("file_name"), text.alias("text")) for k, wanted, text in (("raw", raw, F.col("body")), ("pretty", pretty, pretty_json("body"))) if wanted]
    rows = responses.where(F.try_parse_json("body").isNotNull()).select(F.explode(F.array(*kinds)).alias("f"))
    return rows.select("f.file_name", "f.text").where("text is not null")
