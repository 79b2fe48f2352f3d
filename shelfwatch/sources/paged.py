"""Paged catalogs as a data source: spark.read.format("catalog_pages"), and as a stream that asks again round by round.

Options: `sources`, a JSON array of configuration entries; `settings`, a JSON object of settings; `transport`, module:name of
a function that takes the settings and gives a fetch.Transport (plain HTTP without it); `every_s`, for streams the seconds
of a round. A host is a partition, whatever sources it has, so its pages are asked for one after the other by one task.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import fields
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from shelfwatch.sources import config, fetch

SCHEMA = "source string, pos long, url string, base_url string, content_type string, body string, round long, error string"


class Host(InputPartition):
    """The sources of one host, as JSON, and the round that they are fetched for."""

    def __init__(self, entries: list[str], round_: int = 0):
        self.entries, self.round = entries, round_


class Fetching:
    """What batches and streams share: sources by host, and the fetching of one host's."""

    def __init__(self, options: dict[str, str]):
        told = json.loads(options.get("settings", "{}"))
        known = {f.name for f in fields(config.Settings)}
        if unknown := set(told) - known:
            raise ValueError(f"no such settings: {sorted(unknown)}")
        self.settings, self.transport = config.settings(told, {}), options.get("transport")
        self.entries = [e for e in json.loads(options.get("sources", "[]")) if config.source_of(e)]

    def hosts(self, round_: int = 0) -> list[Host]:
        by_host: dict[str, list[str]] = {}
        for e in self.entries:
            by_host.setdefault(urlsplit(config.source_of(e).base_url).netloc.lower(), []).append(json.dumps(e))
        return [Host(es, round_) for es in by_host.values()]

    def read_host(self, host: Host) -> Iterator[tuple]:
        """A row for each page; a source that throws has one row, with the error and no page, and the others go on."""
        for s in (config.source_of(json.loads(e)) for e in host.entries):
            try:
                if self.transport:
                    module, _, name = self.transport.partition(":")
                    get = getattr(importlib.import_module(module), name)(self.settings)
                else:
                    get = fetch.http(self.settings.http_timeout_s)
                pages = list(fetch.Fetcher(get, self.settings, s.jitter_multiplier).pages(s))
            except Exception as e:  # noqa: BLE001  whatever a transport throws
                yield s.name, None, None, s.base_url, None, None, host.round, f"{type(e).__name__}: {e}"
                continue
            for n, url, r in pages:
                yield s.name, n, url, s.base_url, r.headers.get("content-type", ""), r.body, host.round, None


class PageReader(Fetching, DataSourceReader):
    def partitions(self) -> list[Host]:
        return self.hosts() or [Host([])]

    def read(self, partition: Host) -> Iterator[tuple]:
        return self.read_host(partition)


class PageStream(Fetching, DataSourceStreamReader):
    """Offsets are rounds of `every_s` seconds since 1970. A micro-batch fetches all sources once, for its last round: rounds that passed meanwhile are not made up for, and a batch that is run again asks again."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.every = float(options.get("every_s", 86_400))

    def initialOffset(self) -> dict:
        return {"round": int(time.time() // self.every) - 1}

    def latestOffset(self) -> dict:
        return {"round": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[Host]:
        return self.hosts(end["round"]) if end["round"] > start["round"] else []

    def read(self, partition: Host) -> Iterator[tuple]:
        return self.read_host(partition)


class CatalogPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStream:
        return PageStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogPages)
