"""Visible text of HTML and its character references, as column expressions that stay in the JVM.

A page is read as Python's tolerant parser reads it when it is fed but never closed: what an unclosed tag, comment,
script or style begins is lost, and so is a last run of text that may end within a character reference ("Sweet R&D").
Hidden elements nest; an end tag of any of them closes one. An attribute's quote that never ends doesn't hold a '>'.
With closed=True a reference needs its ';': "&amp" then stays as it is, and no text is lost for a reference that may be open.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch.functions.once import once

# The tags that hide text or end a line.
SKIPPED_TAGS = ("script", "style", "head", "noscript", "svg", "canvas")
LINE_TAGS = ("br", "p", "li", "div", "section")

# Loops are possessive: Java then neither recurs nor goes back, however long a tag is.
REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
HIDES, LINE = rf"(?:{'|'.join(SKIPPED_TAGS)})(?=[\s/>])", rf"(?:{'|'.join(LINE_TAGS)})(?=[\s/>])"
MARK = "</>"  # what stands for markup that shows nothing: as markup it shows nothing itself
OPENS, CLOSES = rf"<{HIDES}{REST}(?<!/)>", rf"</\s*+{HIDES}{REST}>"
SILENT = "<(?:" + "|".join((
    r"!--.*?(?:--\s*>|\z)",
    r"!\[(?:cdata|temp|ignore|include|rcdata)\b.*?(?:\]\s*\]\s*>|\z)",
    rf"(script|style)(?=[\s/>]){REST}(?<!/)>.*?(?:</\s*\1\s*>|\z)",
    rf"{HIDES}{REST}(?<=/)>",
    rf"(?!{HIDES}|{LINE})[a-z]{REST}>",
    rf"/(?!\s*{HIDES})[^>]*+>",
    r"[!?][^>]*+>",
    r"[a-z/!?](?![^>]*+>).*\z",
    r"\z",
)) + ")"
HIDDEN = rf"{OPENS}(?:[^<]++|<(?!/?\s*{HIDES}))*+{CLOSES}"
# All blanks, in runs that aren't one space already.
BLANK = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = rf"[{BLANK}][ {BLANK}]*+| [ {BLANK}]++"
CUT_SHORT = rf"&[^ {BLANK};&<]{{0,33}}\z"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\r\f <&#;]{1,32};?)"
CLOSED = REFERENCE.replace(";?", ";")
# References by name as the standard library has them; those without ';' may stand before further letters.
COMMON = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "copy;", "reg;", "trade;", "eacute;", "rsquo;", "ndash;", "mdash;")
NAMED = json.dumps({**{k: html5[k] for k in COMMON}, **html5})
BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
# Numbers 128 to 159 mean what Windows-1252 has there.
WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def _numbered(ref: Column) -> Column:
    digits = F.regexp_replace(ref, r"^&#[xX]?0*|;$", "")
    n = F.when(F.length(digits) > 7, F.lit(0x110000)).when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("int")).otherwise(F.conv(digits, 10, 10).cast("int"))
    n = F.when(digits == "", F.lit(0)).otherwise(n)
    unknown = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    known = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(unknown, F.lit("�")).when(n.between(128, 159), F.lit(WINDOWS).substr(n - 127, F.lit(1))).when(none, F.lit("")).otherwise(known)


def _named(ref: Column, closed: bool) -> Column:
    table = F.from_json(F.lit(NAMED), "map<string,string>")
    name = F.substring(ref, 2, 40)
    if closed:
        return F.coalesce(F.try_element_at(table, name), ref)
    bare = F.regexp_extract(name, rf"^(?:{BARE})", 0)
    start = F.concat(F.try_element_at(table, bare), name.substr(F.length(bare) + 1, F.length(name)))
    return F.coalesce(F.try_element_at(table, name), F.when(bare != "", start), ref)


def unescaped(text: Column, closed: bool = False) -> Column:
    """Character references as the characters that they stand for; what is none stays."""
    return once(text, lambda s: F.when(F.contains(s, F.lit("&")), _decoded(s, closed)).otherwise(s))


def _decoded(s: Column, closed: bool) -> Column:
    reference = CLOSED if closed else REFERENCE
    between, found = F.split(s, reference), F.regexp_extract_all(s, F.lit(reference), F.lit(0))
    shown = F.transform(found, lambda m: F.when(m.startswith("&#"), _numbered(m)).otherwise(_named(m, closed)))
    return F.array_join(F.zip_with(between, shown, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def _outside(h: Column) -> Column:
    """What no hidden element holds, where such elements nest or lack an end: a fold over their tags gives the depth."""
    tag = rf"(?i)(?:{OPENS}|{CLOSES})"
    marks = F.regexp_extract_all(h, F.lit(tag), F.lit(0))
    depths = F.aggregate(marks, F.array(F.lit(0)), lambda at, m: F.concat(at, F.array(F.greatest(F.element_at(at, -1) + F.when(m.startswith("</"), -1).otherwise(1), F.lit(0)))))
    return F.array_join(F.zip_with(F.split(h, tag), depths, lambda part, depth: F.when(depth == 0, part).otherwise("")), MARK)


def _tail_kept(h: Column) -> Column:
    """Without the last text token if that may end within a reference: it begins behind the last '<' that is markup, or is itself one."""
    return F.when(h.rlike(CUT_SHORT), F.regexp_replace(h, r"(?:\A|<(?=[A-Za-z/])|(<))[^<]*+\z", "$1")).otherwise(h)


def visible_lines(html: Column, closed: bool = False) -> Column:
    """Text that a reader sees, a line for each start of a block element, none of them empty."""
    h = F.regexp_replace(html, rf"(?is){SILENT}", MARK)
    h = h if closed else once(h, _tail_kept)
    h = once(F.regexp_replace(h, rf"(?i){HIDDEN}", MARK), lambda h: F.when(h.rlike(rf"(?i)</?\s*{HIDES}"), _outside(h)).otherwise(h))
    h = F.regexp_replace(F.replace(h, F.lit(MARK), F.lit(" ")), BLANKS, " ")
    h = F.replace(F.regexp_replace(h, rf"(?i)<{LINE}{REST}>", "\n"), F.lit("<"), F.lit(" < "))
    lines = F.transform(F.split(h, "\n"), lambda x: F.trim(F.regexp_replace(unescaped(x, closed), BLANKS, " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
