"""The paged catalog source and the sink of named files."""

import json
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from shelfwatch.sources import config, fetch, named_files, paged
from tests import fake_site

SETTINGS = {"jitter_min_s": 0.0, "jitter_max_s": 0.0}
PAGES = config.Pages(max_pages=5)
SOURCES = [config.Source("one", "https://one", pagination=PAGES), config.Source("other one", "https://one/x", pagination=PAGES), config.Source("bad", "https://bad", pagination=PAGES), config.Source("two", "https://two", products_path="/private/p.json", pagination=PAGES), config.Source("three", "https://three", pagination=PAGES)]


def options(**more):
    return {"sources": json.dumps([asdict(s) for s in SOURCES] + [{"base_url": ""}]), "settings": json.dumps(SETTINGS), "transport": "tests.fake_site:transport"} | more


def test_batch_equals_capture(spark):
    paged.register(spark)
    df = spark.read.format("catalog_pages").options(**options()).load()
    got = df.collect()
    want = fetch.capture(spark, SOURCES, config.settings(SETTINGS, {}), lambda: fake_site.transport(None)).collect()
    assert sorted((r.source, r.pos, r.url, r.base_url, r.content_type, r.body) for r in got if r.error is None) == sorted(map(tuple, want))
    assert {r.source for r in want} == {"one", "other one", "three"}
    assert [(r.source, r.pos, r.error) for r in got if r.error] == [("bad", None, "LookupError: unknown encoding: x")]
    assert df.rdd.getNumPartitions() == 4  # hosts


def test_no_sources(spark):
    paged.register(spark)
    assert spark.read.format("catalog_pages").load().count() == 0
    with pytest.raises(Exception, match="no such settings"):
        spark.read.format("catalog_pages").option("settings", '{"jiter": 1}').load().count()


def test_rounds():
    s = paged.PageStream(options(every_s="1000000"))
    first, now = s.initialOffset(), s.latestOffset()
    assert now["round"] == first["round"] + 1 and len(s.partitions(first, now)) == 4 and s.partitions(now, now) == []
    assert {r[6] for p in s.partitions(first, now) for r in s.read(p)} == {now["round"]}


def test_stream(spark, tmp_path):
    """A round is fetched once, also over a restart."""
    paged.register(spark)
    for _ in range(2):
        q = spark.readStream.format("catalog_pages").options(**options(every_s="1000000")).load().writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").start(f"file://{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(f"file://{tmp_path}/out").where("error is null").count() == 9


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_named_files(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".md")).alias("file_name"), F.concat(F.lit("té "), F.col("id").cast("string")).alias("text"))
    (tmp_path / "f3.md").write_text("older")
    (tmp_path / "kept.md").write_text("kept")
    for folder in (f"file://{tmp_path}", str(tmp_path)):
        named_files.write(rows.repartition(5), folder)
        assert names(tmp_path) == sorted(["kept.md", *(f"f{i}.md" for i in range(40))])
        assert (tmp_path / "f3.md").read_text() == "té 3" and (tmp_path / "kept.md").read_text() == "kept"
    named_files.write(spark.createDataFrame([("same", "a"), ("same", "b"), ("none", None)], "file_name string, text string"), str(tmp_path))
    assert (tmp_path / "same").read_text() == "b" and (tmp_path / "none").read_text() == ""


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = spark.range(20).select(F.when(F.col("id") == 13, F.raise_error(F.lit("broken"))).otherwise(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("file_name"), F.lit("t").alias("text"))
    with pytest.raises(Exception, match="broken"):
        named_files.write(rows.repartition(4), str(tmp_path))
    with pytest.raises(Exception, match="no file name"):
        named_files.write(spark.createDataFrame([("a", "x"), ("../b", "y")], "file_name string, text string"), str(tmp_path))
    assert names(tmp_path) == []
