"""Text scalars as column expressions: visible text of HTML, redaction, caps, rendering of fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch.functions.html import visible_lines
from shelfwatch.functions.once import once

# Lines with one of these are page furniture; a phrase may be part of a longer word.
BOILERPLATE = ("cookie", "privacy policy", "terms of service", "newsletter", "subscribe", "sign up", "log in", "login", "add to cart", "cart", "checkout", "shipping", "search", "filter")
# What personal data looks like.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)\+?\d[\d\s().-]{7,}\d"
LEAST_DIGITS = 10


def collapse(s: Column) -> Column:
    """Runs of blanks of any script as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def printable(s: Column) -> Column:
    return F.regexp_replace(s, r"[\p{C}\p{Z}&&[^ ]]", "")


def cap(s: Column, chars: int) -> Column:
    """The first chars characters; 0 or less is no limit."""
    return s if chars <= 0 else F.substring(s, 1, chars)


def field(s: Column, chars: int = 0) -> Column:
    return cap(printable(collapse(s)), chars)


def redact_email(s: Column) -> Column:
    return F.regexp_replace(s, EMAIL, "[redacted email]")


def redact_phone(text: Column) -> Column:
    """Digit runs that look like a phone number and have ten digits or more."""

    def redacted(s: Column) -> Column:
        between, found = F.split(s, PHONE), F.regexp_extract_all(s, F.lit(PHONE), F.lit(0))
        shown = F.transform(found, lambda m: F.when(F.length(F.regexp_replace(m, r"(?U)\D", "")) >= LEAST_DIGITS, "[redacted phone]").otherwise(m))
        return F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")

    return once(text, redacted)


def without_boilerplate(lines: Column, phrases: Sequence[str] = BOILERPLATE) -> Column:
    """An array of lines without those that hold a phrase."""

    def clean(lower: Column) -> Column:
        out = F.lit(True)
        for p in phrases:
            out = out & ~F.contains(lower, F.lit(p))
        return out

    return F.filter(lines, lambda line: once(F.lower(line), clean))


def sanitized(html: Column, chars: int = 0, drop_boilerplate: bool = True, closed: bool = False) -> Column:
    """One line of visible text without page furniture, unprintable characters and personal data; closed: references need their ';'."""
    lines = F.split(visible_lines(html, closed), "\n")
    lines = without_boilerplate(lines) if drop_boilerplate else lines
    return cap(redact_phone(redact_email(printable(collapse(F.array_join(lines, " "))))), chars)


def trimmed_at(s: Column, phrases: Sequence[str]) -> Column:
    """What stands before the first of the phrases, in either case; blanks at its end go."""
    used = [p.strip().lower() for p in phrases if p.strip()]
    if not used:
        return s
    found = F.filter(F.array(*(F.locate(p, F.lower(s)) for p in used)), lambda x: x > 0)
    first = F.array_min(found)
    return F.when(first.isNull(), s).otherwise(F.regexp_replace(s.substr(F.lit(1), first - 1), r"(?U)\s+$", ""))


def variant_lines(variants: Column) -> Column:
    """Lines for an array of (title, price, grams, available); none for an empty one."""

    def line(v: Column) -> Column:
        parts = (F.when(v["title"] != "", v["title"]), F.when(v["price"] != "", F.concat(F.lit("$"), v["price"])), F.when(v["grams"] != 0, F.concat(v["grams"].cast("string"), F.lit("g"))), F.when(v["available"], "available").otherwise("unavailable"))
        return F.concat(F.lit("    - "), F.concat_ws(" | ", *parts))

    return F.when(F.size(variants) > 0, F.concat(F.array(F.lit("  variants:")), F.transform(variants, line))).otherwise(F.array().cast("array<string>"))


# Names of simplified Chinese; all else is English.
CHINESE = ("zh", "zh-cn", "zh-hans", "cn", "simplified", "simplified-chinese")


def language(value: Column) -> Column:
    return F.when(F.lower(F.trim(value)).isin(*CHINESE), "zh").otherwise("en")


def language_of(value: str) -> str:
    """As language(), for one value."""
    return "zh" if value.strip().lower() in CHINESE else "en"


def tokens(values: Column) -> Column:
    """Trimmed, in lower case, blank ones gone, each once."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: x != ""))
