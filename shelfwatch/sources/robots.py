"""Robots rules as a table: robots.txt files read once for each origin, and URLs held against their origin's rules by a join.

As the standard library's parser has it, the first rule that a path begins with decides, and what no rule says is allowed.
"""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwatch.functions import urls

RULES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("allow", T.BooleanType())]))


def origin_of(url: Column) -> Column:
    """Scheme and host of a URL; null for one that lacks either."""
    scheme, host = urls.part(url, 2), urls.part(url, 4)
    return F.when((scheme != "") & (host != ""), F.concat(F.lower(scheme), F.lit("://"), host))


def rules_in(body: str, agent: str) -> list[dict]:
    """The rules of a robots.txt for an agent, in its order."""
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    own = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
    return [{"path": line.path, "allow": line.allowance} for line in own.rulelines] if own else []


@F.pandas_udf(T.StringType())
def asked_path(found: pd.Series) -> pd.Series:
    """What a rule's path is compared with: path, query and fragment of a URL, in one way of quoting."""

    def one(url: str | None) -> str | None:
        try:
            return None if url is None else quote(urlunparse(("", "", *urlparse(unquote(url))[2:]))) or "/"
        except ValueError:  # no URL
            return None

    return found.map(one)


def rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """(origin, rules) of robots.txt files (origin, status, body), one for each origin; a file that didn't come, or with an error's status, has no rules."""

    @F.pandas_udf(RULES)
    def read(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: rules_in(body or "", agent))

    came = F.when(F.col("status") < 400, F.col("body"))
    return files.groupBy("origin").agg(F.max(came).alias("body")).select("origin", read("body").alias("rules"))


def decided(rows: DataFrame, table: DataFrame, url: str = "url", name: str = "allowed") -> DataFrame:
    """rows with a flag: may this URL be fetched? What has no scheme or host may not; an origin without rules allows all."""
    known = table.select(F.col("origin").alias("_origin"), F.col("rules").alias("_rules"))
    asked = rows.withColumn("_origin", origin_of(F.col(url))).withColumn("_path", asked_path(url))
    first = F.try_element_at(F.filter("_rules", lambda r: (r["path"] == "*") | F.startswith(F.col("_path"), r["path"])), F.lit(1))
    allow = F.col("_origin").isNotNull() & F.col("_path").isNotNull() & F.coalesce(first["allow"], F.lit(True))
    return asked.join(known, "_origin", "left").select(*rows.columns, allow.alias(name))
