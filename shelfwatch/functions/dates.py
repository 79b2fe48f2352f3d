"""Dates of catalog items. Whatever can't be read is null; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?([+-]\d{2}(:?\d{2})?)?)?$"
SOURCES = ("shopify_published_at", "http_last_modified", "wix_lastmod", "seen_at")


def iso_date(s: Column) -> Column:
    """The UTC date of an ISO 8601 timestamp, with or without zone; years or months alone are none, yyyymmdd is one."""
    t = F.regexp_replace(F.trim(s), "Z$", "+00:00")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?=$|T)", "$1-$2-$3")
    t = F.regexp_replace(t, r"([T ]\d{2})(?=$|[+-])", "$1:00")
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2})(?=$|[+-])", "$1:00")
    t = F.regexp_replace(t, r"(:\d{2}[+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(t.rlike(ISO), F.to_date(t.try_cast("timestamp")))


def http_date(s: Column) -> Column:
    """The UTC date of an RFC 2822 date; the day of the week doesn't matter."""
    t = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3,9},\s*", "")
    t = F.regexp_replace(t, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    t = F.when(t.rlike(r"[+-]\d{4}$"), t).otherwise(F.concat(t, F.lit(" +0000")))
    return F.to_date(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")))


def lastmod_date(s: Column) -> Column:
    return F.coalesce(http_date(s), iso_date(s))


def cascade(published: Column, modified: Column, lastmod: Column, seen: Column) -> Column:
    """struct(date, source) of the first that can be read; date null and source unknown if none can."""
    dates = (iso_date(published), http_date(modified), lastmod_date(lastmod), iso_date(seen))
    # Each date is read once, for both the day and its source.
    told = F.array(*(F.struct(d.alias("date"), F.lit(name).alias("source")) for d, name in zip(dates, SOURCES, strict=True)))
    first = F.get(F.filter(told, lambda x: x["date"].isNotNull()), F.lit(0))
    return F.coalesce(first, F.struct(F.lit(None).cast("date").alias("date"), F.lit("unknown").alias("source")))


def run_id(ts: Column) -> Column:
    """A run's name: its day in UTC."""
    return F.date_format(ts, "yyyyMMdd")


def run_day(run: Column) -> Column:
    return F.to_date(run, "yyyyMMdd")


def window_start(day: Column, days: int) -> Column:
    """The first of so many days up to a day; under one day counts as one."""
    return F.date_sub(day, max(1, days) - 1)


def in_window(day: Column, run_day: Column, days: int) -> Column:
    """Within so many days up to run_day, both ends included."""
    return day.between(window_start(run_day, days), run_day)
