import html as stdlib
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from shelfwatch.functions import html, text

SCRAPS = [
    "<", ">", "a < b", "3<4", "Sweet R&D", "Black & White", " ", "\n", "&amp;", "&ampx", "&nbsp;", "&#39;", "&#x1F600;", "&notit;", "&eacute", "&#150;", "&#0;", "&bogus;", "é ü",
    "<p>", "<P class='a>b'>", "</p>", "<br/>", "<br>", "<li>", "<section id=x>", "<pre>", "</div>", "<div\n>", "<b>bold</b>", "<a href=\"x>y\" title='q'>", "</>", "<!-- c <p> -->", "<!DOCTYPE html>", "<?php x ?>",
    "<script>if (a<b) '<p>'</script>", "<style>p{}</style>", "<script src=x />", "<script>", "</script>", "<head>", "</head>", "<svg>", "</svg>", "<svg/>", "<noscript>", "</noscript>", "<canvas>", "</canvas>",
    "<!--", "<scripted>", "<header>", "<style", "plain words", "x", "&", ";", "</ head >", "<![CDATA[ x > y ]]>",
]


class Events(HTMLParser):
    def __init__(self):
        super().__init__()
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("open", tag))

    def handle_endtag(self, tag):
        self.seen.append(("close", tag))

    def handle_data(self, data):
        self.seen.append(("text", data))


def shown(page):
    """Lines of a page by the standard library's parser."""
    parser = Events()
    parser.feed(page)
    depth, lines = 0, [[]]
    for kind, value in parser.seen:
        if kind != "text" and value in html.SKIPPED_TAGS:
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif depth == 0 and kind == "open" and value in html.LINE_TAGS:
            lines.append([])
        elif depth == 0 and kind == "text":
            lines[-1] += value.split()
    return "\n".join(" ".join(words) for words in lines if words)


def compared(spark, pages, column, want):
    got = spark.createDataFrame(list(enumerate(pages)), "n int, x string").repartition(4).select("n", "x", column.alias("got")).collect()
    assert len(got) == len(pages)
    return [(r.x, r.got, want(r.x)) for r in got if r.got != want(r.x)]


def test_visible_lines_against_standard_parser(spark):
    rng = random.Random(3)
    pages = ["", "Sweet R&D", "<p>Sweet R&D", "Black & White", "<p>a</p>b & <i>R&D", "1 < R&D", "<head>x</head></head>y", "<svg><svg>a</svg>b</svg>c", "<script>never closed <p>x", "<p>a<script>x", "a</script>b", "<p>a<b"]
    pages += ["".join(rng.choice(SCRAPS) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    assert compared(spark, pages, html.visible_lines(F.col("x")), shown)[:5] == []


def test_references_against_standard_library(spark):
    from html.entities import html5

    given = [f"a &{name} b&{name}" for name in html5] + [f"&#{n};&#x{n:x}" for n in [*range(300), 0xD7FF, 0xD800, 0xFDD0, 0xFFFE, 0x1FFFF, 0x10FFFF, 0x110000, 10**9]] + ["&ampamp;", "&notin", "&notit;", "&#0000000000065;", "&#;", "&", "& a", "&x" * 30, "&" + "y" * 50]
    assert compared(spark, given, html.unescaped(F.col("x")), stdlib.unescape)[:5] == []


def test_null_and_very_long_pages(spark):
    assert spark.range(1).select(html.visible_lines(F.lit(None).cast("string")).alias("x")).head().x is None
    pages = ["<p>word &amp; more</p> " * 100_000, "<a " + "b='c>' " * 200_000 + ">end", "<svg><path/></svg>t " * 100_000, "<" * 300_000 + "x", "&amp" * 100_000 + " ", ">" * 300_000 + "R&D ", "<!-- " * 200_000]
    got = [r.x for r in spark.createDataFrame(list(enumerate(pages)), "n int, x string").orderBy("n").select(html.visible_lines(F.col("x")).alias("x")).collect()]
    assert got[0] == "\n".join(["word & more"] * 100_000) and got[1] == "end" and got[2] == " ".join(["t"] * 100_000)
    assert got[3] == " ".join("<" * 299_999)
    assert got[4] == "&" * 100_000 and got[5].endswith(">R&D") and got[6] == ""


def test_no_python_worker(spark, sf):
    plan = spark.read.parquet(f"{sf}/pages.parquet").select(text.sanitized(F.col("html")).alias("x"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


OPEN_REFERENCES = [(1, "<h1>a &amp;&amp</h1><p>b&lt c&nbsp</p>&copy; d &amp; &#39;e&#39;"), (2, "<p>a&amp;amp</p><p>&amp;lt;</p>Sweet R&D"), (3, "<p>&middot; x&quot"), (4, "plain")]


def against_sql(spark, path, name):
    """Rows of a query over OPEN_REFERENCES and those of its SQL."""
    import duckdb

    from shelfwatch.queries import ORACLE_SQL, QUERIES

    spark.createDataFrame(OPEN_REFERENCES, "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    return sorted(tuple(r) for r in QUERIES[name](spark, str(path)).collect()), sorted(con.sql(ORACLE_SQL[name]).fetchall())


def test_visible_text_query_leaves_open_references(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "html_visible_text")
    assert got == want
    assert got[0] == (1, "a &&amp\nb&lt c&nbsp © d & 'e'")


def test_sanitized_query_leaves_open_references(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "sanitized_page")
    assert got == want
    assert got[1] == (2, "a&amp &lt; Sweet R&D")
