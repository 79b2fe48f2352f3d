"""The key of the first-seen store."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seen_hash(url: Column, title: Column, description: Column) -> Column:
    """SHA3-512 of the three trimmed fields, a line each; null counts as ''. Project it before joining on it."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    text = F.concat_ws("\n", strip(url), strip(title), strip(description))
    return F.reflect(F.lit("org.apache.commons.codec.digest.DigestUtils"), F.lit("sha3_512Hex"), text)
