"""Runs over captured responses: catalogs to products, new items, reports, digests; resumed and digest-only runs."""

from __future__ import annotations

import argparse
import importlib
import logging
import uuid
from collections.abc import Callable, Mapping
from dataclasses import fields
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions import text
from shelfwatch.operators import classify, render, reparse
from shelfwatch.operators.relational import ordered_union
from shelfwatch.operators.seen import SeenStore
from shelfwatch.plans import evaluator, logs
from shelfwatch.sources import config, fetch, jsonld, reports, rules, sitemap
from shelfwatch.sources.config import Settings, Source

WINDOW_DAYS = 7
LOG = logging.getLogger("shelfwatch")


def needs_page() -> Column:
    """Is a product described by its page only? Sources whose feed has the descriptions never look at pages."""
    return (F.col("body_html") == "") & (F.col("platform") != "shopify")


def with_page_text(products: DataFrame, pages: DataFrame, chars: int = 0, stop_phrases: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    """products with page_text, cut at its source's stop phrases, and modified; pages: (url, html, modified)."""
    about = pages.select("url", jsonld.page_text(F.col("html"), (), chars).alias("page_text"), "modified")
    rows = products.withColumn("_needs", needs_page()).join(about, "url", "left")
    shown = F.col("page_text")
    for source, phrases in (stop_phrases or {}).items():
        shown = F.when(F.col("source") == source, text.trimmed_at(F.col("page_text"), phrases)).otherwise(shown)
    told = lambda c: F.when(F.col("_needs"), F.coalesce(c, F.lit(""))).otherwise("")
    return rows.select(*products.columns, told(shown).alias("page_text"), told(F.col("modified")).alias("modified"))


class Run:
    """One day's run. run_day is fixed when it starts, so nothing depends on the clock later."""

    def __init__(self, spark: SparkSession, settings: Settings, sources: list[Source], run_id: str, store: SeenStore, ask: evaluator.Evaluator = evaluator.stub, ask_digest: evaluator.Evaluator | None = None, deny: DataFrame | None = None):
        self.spark, self.s, self.run_id, self.store, self.ask, self.ask_digest = spark, settings, run_id, store, ask, ask_digest or ask
        self.sources = sources if deny is None else self.not_denied(sources, deny)
        self.run_day = datetime.strptime(run_id, "%Y%m%d").date()
        self.lang = text.language_of(self.s.language)

    def not_denied(self, sources: list[Source], deny: DataFrame) -> list[Source]:
        """Sources whose host isn't on the denylist, in their order."""
        urls = self.spark.createDataFrame([(i, s.base_url) for i, s in enumerate(sources)], "i int, base_url string")
        left = {r.i for r in config.allowed(urls, deny).collect()}
        for i, s in enumerate(sources):
            if i not in left:
                LOG.info("%s is denied", s.name)
        return [s for i, s in enumerate(sources) if i in left]

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table beside the store: what several outputs of a run share is computed once and survives lost executors. It goes with the session."""
        at = f"{self.store.path}-runs/{self.run_id}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(at)
        self.store.fs.deleteOnExit(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at))
        return self.spark.read.schema(df.schema).parquet(at)

    def products(self, responses: DataFrame, wanted: list[Source]) -> DataFrame | None:
        """Products of the sources, as a table, in one scan; one whose responses can't be parsed is found by halves, logged and left out, and the others go on. None if none is left."""
        try:
            return self.saved(rules.parse(responses, rules.of(self.spark, wanted), self.s.max_products_per_source), "products")
        except Exception as e:  # noqa: BLE001  whichever source it was, by itself it fails alone
            if len(wanted) == 1:
                LOG.error("%s failed: %s", wanted[0].name, logs.snippet(str(e), 500))
                return None
        half = len(wanted) // 2
        parts = [df for some in (wanted[:half], wanted[half:]) if (df := self.products(responses, some)) is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def log_unreadable(self, responses: DataFrame) -> None:
        """The beginnings of responses that should be JSON and aren't."""
        bad = responses.where(F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("json")) & F.try_parse_json("body").isNull())
        most = self.s.log_json_max_chars
        for r in bad.select("source", "pos", (F.substring("body", 1, most + 1) if most > 0 else F.col("body")).alias("body")).limit(20).collect():
            LOG.warning("%s, page %s is no JSON: %s", r.source, r.pos, logs.snippet(r.body or "", most))

    def classified(self, products: DataFrame, lastmods: DataFrame) -> DataFrame:
        """products, described and marked new or not; known ones are recorded in the store, whether in the window or not."""
        order = F.struct("source", "pos", "item")
        about = products.select("url", F.coalesce(F.nullif(text.field(F.col("page_text")), F.lit("")), text.sanitized(F.col("body_html"), 0, False)).alias("description"), order.alias("pos"))
        rows = self.saved(classify.described(products.drop("modified"), about, products.select("url", "modified", order.alias("pos")), lastmods), "described")
        out = classify.marked(rows, self.store.read(), F.lit(self.run_day), WINDOW_DAYS, True, order=["source", "pos", "item"])
        # The store read above is the old snapshot, before and after the upsert below.
        stamp = f"{self.run_day.isoformat()}T00:00:00+00:00"
        batch = rows.select("hash", "url", F.col("name").alias("title"), "description", F.lit(stamp).alias("first_seen_at"), "shopify_updated_at", F.col("source").alias("roaster"), "platform", order.alias("pos"))
        self.store.upsert(batch)
        return out

    def report_rows(self, products: DataFrame) -> DataFrame:
        """(file_name, text): a report for each source with products."""
        lists = render.item_list(products, ["source"], ["pos", "item"], self.s.batch_page_text_max_chars).withColumnRenamed("text", "items")
        prompts = render.batch_prompts(products, ["source"], ["pos", "item"], self.lang, self.s.batch_page_text_max_chars).select(F.col("source").alias("name"), F.col("text").alias("prompt"))
        if self.s.save_prompt:
            reports.write(prompts.select(reports.file_name(self.run_id, F.col("name"), "prompt", "txt").alias("file_name"), F.col("prompt").alias("text")), self.s.reports_dir)
        if self.s.fetch_only or self.s.skip_gemini:
            told = prompts.withColumn("response", F.lit(None).cast("string"))
            note = F.lit("Text generation was skipped.")
        else:
            told = evaluator.evaluated(prompts, self.ask)
            note = F.when(F.col("got.text") == "", f"{render.FAILED_SENTINEL}\n").otherwise("")
        told = told.withColumn("got", evaluator.read(F.col("response")))
        rows = told.join(lists, told["name"] == lists["source"])
        stamp = F.lit(f"{self.run_day.isoformat()}T00:00:00+00:00")
        return rows.select(reports.file_name(self.run_id, F.col("name")).alias("file_name"), render.report(F.col("name"), stamp, self.run_id, note, F.col("got.text"), F.col("got.grounding"), F.col("items")).alias("text"))

    def new_items(self, day_reports: DataFrame) -> DataFrame:
        """Items of the day's reports that are new by the store, which is only read."""
        found = self.saved(reparse.items(day_reports), "items")
        rows = found.withColumns({"hash": classify.seen_hash(F.col("url"), F.col("name"), F.max_by("description", F.struct("file_name", "item")).over(_by_url())), "published": F.lit(""), "modified": F.lit(""), "lastmod": F.lit("")})
        marked = classify.marked(rows, self.store.read(), F.lit(self.run_day), WINDOW_DAYS, False)
        return classify.new_items(found, marked)

    def digests(self, day_reports: DataFrame, names: DataFrame) -> DataFrame:
        """(file_name, text) of the digests; names: (name, pos) of all sources, of which missing ones count as failed."""
        ranked = day_reports.withColumn("pos", F.col("file_name"))
        items = self.saved(self.new_items(day_reports), "new").withColumn("pos", F.struct("file_name", "item"))
        entries = items.withColumn("entry", render.entry([(c, text.field(F.col(c), 400 if c == "url" else 200)) for c in ("roaster", "product_id", "name", "url")], text.field(F.col("list_price"), 40), text.field(F.col("badge"), 40), F.col("variant_lines"), text.field(F.col("description"), self.s.batch_page_text_max_chars)))
        jobs = render.digest_jobs(ranked, entries, self.lang, self.s.new_products_digest)
        there = day_reports.select("file_name")
        gone = reparse.missing(names.withColumn("file_name", reports.file_name(self.run_id, F.col("name"))), there, "file_name")
        failed = reparse.failed_names(ranked)
        order = ordered_union(failed.select("name", F.struct(F.col("pos.pos").alias("a"), F.col("pos.n").alias("b")).alias("pos")), gone.select("name", F.struct(F.lit("").alias("a"), F.col("pos").cast("int").alias("b")).alias("pos")))
        names_failed = [r.name for r in order.orderBy("grp", "pos").collect()]
        if self.s.save_prompt and not self.s.skip_gemini:
            reports.write(jobs.select(F.concat(F.lit(f"{self.run_id}-z-"), "name", F.lit(".prompt.txt")).alias("file_name"), F.col("prompt").alias("text")), self.s.reports_dir)
        if self.s.skip_gemini:
            return jobs.select(F.concat(F.lit(f"{self.run_id}-z-"), "name", F.lit(".prompt.txt")).alias("file_name"), F.col("prompt").alias("text"))
        told = evaluator.evaluated(jobs, self.ask_digest, 1).withColumn("got", evaluator.read(F.col("response")))
        return told.select(F.concat(F.lit(f"{self.run_id}-z-"), "name", F.lit(".md")).alias("file_name"), render.with_failures(F.col("got.text"), names_failed).alias("text")).where("text <> ''")

    def full(self, responses: DataFrame, pages: DataFrame | Callable[[DataFrame], DataFrame], lastmods: DataFrame, only: DataFrame | None = None) -> None:
        """All of it, or for the sources in `only` (name). pages are given, or made for the products (source, url) that need them."""
        wanted = self.sources if only is None else [s for s in self.sources if s.name in {r.name for r in only.select("name").collect()}]
        names = self.spark.createDataFrame([(s.name, i) for i, s in enumerate(self.sources)], "name string, pos int")
        self.log_unreadable(responses)
        if self.s.save_raw_products_json or self.s.save_pretty_products_json:
            reports.write(reports.assets(responses, self.run_id, self.s.save_raw_products_json, self.s.save_pretty_products_json), self.s.reports_dir)
        found = self.products(responses, wanted) if wanted else None
        if found is not None:
            if callable(pages):
                pages = self.saved(pages(found.where(needs_page())), "pages")
            phrases = {s.name: s.page_text_stop_phrases for s in wanted if s.page_text_stop_phrases}
            found = self.saved(with_page_text(found, pages, self.s.page_text_max_chars, phrases), "described")
            counts = classify.counts(self.classified(found, lastmods)).first()
            LOG.info("products: %s", counts.asDict())
            if self.s.save_report:
                reports.write(self.report_rows(found), self.s.reports_dir)
        reports.write(self.digests(reports.scan(self.spark, self.s.reports_dir, self.run_id), names), self.s.reports_dir)

    def live(self, transport: Callable[[], fetch.Transport]) -> None:
        """A full or resumed run over what is fetched now."""
        responses = self.saved(fetch.capture(self.spark, self.sources, self.s, transport), "responses")
        dated = [s for s in self.sources if s.platform == "wix"]
        files = self.saved(fetch.capture_sitemaps(self.spark, dated, self.s, transport), "sitemaps") if dated else None
        lastmods = self.spark.createDataFrame([], "url string, lastmod string, pos int")
        for i, s in enumerate(dated):
            own = sitemap.product_lastmods(files.where(F.col("source") == s.name).select("url", "xml"), s.base_url, s.product_link_patterns, s.product_link_exclude_patterns)
            lastmods = lastmods.unionByName(own.select("url", "lastmod", F.lit(i).alias("pos")))
        pages = lambda products: fetch.capture_pages(products, self.sources, self.s, transport)
        (self.resume if self.s.resume else self.full)(responses, pages, lastmods)

    def resume(self, responses: DataFrame, pages: DataFrame | Callable[[DataFrame], DataFrame], lastmods: DataFrame) -> None:
        """The sources whose report is missing or failed, then new digests."""
        names = self.spark.createDataFrame([(s.name, i) for i, s in enumerate(self.sources)], "name string, pos int").withColumn("file_name", reports.file_name(self.run_id, F.col("name")))
        self.full(responses, pages, lastmods, reparse.resume_targets(names, reports.scan(self.spark, self.s.reports_dir, self.run_id), "file_name"))

    def digest_only(self) -> int:
        """Digests of the day's reports; 1 if there are none."""
        found = reports.scan(self.spark, self.s.reports_dir, self.run_id)
        if found.isEmpty():
            return 1
        reports.write(self.digests(found, self.spark.createDataFrame([], "name string, pos int")), self.s.reports_dir)
        return 0


def _by_url():
    from pyspark.sql import Window

    return Window.partitionBy("url")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    """An option for each setting; flags also as --no-..."""
    p = argparse.ArgumentParser(prog="shelfwatch")
    p.add_argument("--config")
    p.add_argument("--client", help="module:name of a text-generation client (plans.evaluator.Client); without it a stub answers")
    p.add_argument("--responses", help="captured responses (Parquet: source, pos, base_url, content_type, body); without them sources are fetched now")
    p.add_argument("--pages", help="captured product pages (Parquet: url, html, modified)")
    p.add_argument("--lastmods", help="sitemap dates (Parquet: url, lastmod, pos)")
    p.add_argument("--run-id")
    for f in fields(Settings):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(name, dest=f.name, action=argparse.BooleanOptionalAction, default=None)
        else:
            p.add_argument(name, dest=f.name, type=type(f.default), default=None)
    return p.parse_args(argv)


def generators(spec: str | None, s: Settings) -> tuple[evaluator.Evaluator, evaluator.Evaluator]:
    """What answers prompts of reports and of digests."""
    if not spec:
        return evaluator.stub, evaluator.stub
    module, _, name = spec.partition(":")
    client = getattr(importlib.import_module(module), name)
    return evaluator.Generation(client, s.model, s.gemini_timeout_s, count=True), evaluator.Generation(client, s.digest_model, s.gemini_timeout_s, search=False)


def main(argv: list[str] | None = None) -> int:
    from shelfwatch.session import session

    args = arguments(argv)
    s = config.settings(vars(args), config.load_json_object(args.config))
    logs.logger(s)
    spark = session("shelfwatch")
    try:
        deny = config.denylist(spark, s.denylist_path) if Path(s.denylist_path).exists() else None
        run = Run(spark, s, config.load_sources(s.roasters_path), args.run_id or datetime.now(timezone.utc).strftime("%Y%m%d"), SeenStore(spark, s.seen_db_path), *generators(args.client, s), deny)
        Path(s.reports_dir).mkdir(parents=True, exist_ok=True)
        if s.digest_only:
            return run.digest_only()
        if not args.responses:
            run.live(lambda: fetch.http(s.http_timeout_s))
            return 0
        responses = spark.read.parquet(args.responses)
        pages = spark.read.parquet(args.pages) if args.pages else spark.createDataFrame([], "url string, html string, modified string")
        lastmods = spark.read.parquet(args.lastmods) if args.lastmods else spark.createDataFrame([], "url string, lastmod string, pos int")
        (run.resume if s.resume else run.full)(responses, pages, lastmods)
        return 0
    except KeyboardInterrupt:
        return 130
