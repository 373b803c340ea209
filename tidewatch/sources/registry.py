"""Sources by name. A source is a Spark DataSource; scans that need a browser or a login register one from outside."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POST_SCHEMA = "slug string, post_id string, title string, url string, published_at string, category string, content string, error string"

Fetch = Callable[[str, int], list[dict]]


class Site(InputPartition):
    def __init__(self, slug: str, host: str, pages: int):
        self.slug, self.host, self.pages = slug, host, pages


class PostReader(DataSourceReader):
    """One partition a host: a host's sites are fetched one after another, hosts side by side. A site that fails gives one row with
    its error and stops no other."""

    def __init__(self, sites: list[dict], fetch: Fetch):
        self.sites, self.fetch = sites, fetch

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[dict]] = {}
        for s in self.sites:
            hosts.setdefault(s.get("host", s["slug"]), []).append(s)
        return [Site(json.dumps(group), host, 0) for host, group in hosts.items()]

    def read(self, partition: Site) -> Iterator[tuple]:
        columns = [c.split()[0] for c in POST_SCHEMA.split(", ")]
        for site in json.loads(partition.slug):
            try:
                for page in range(1, int(site.get("pages", 1)) + 1):
                    for row in self.fetch(site["slug"], page):
                        yield tuple({"slug": site["slug"], "error": None, **row}.get(c) for c in columns)
            except Exception as e:  # isolation is the contract: the error is a row
                yield tuple({"slug": site["slug"], "error": f"{type(e).__name__}: {e}"[-4000:]}.get(c) for c in columns)


def register(spark: SparkSession, name: str, fetch: Fetch) -> None:
    """Makes spark.read.format(name).option("sites", json).load() read posts through fetch(slug, page)."""

    class Posts(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return POST_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return PostReader(json.loads(self.options["sites"]), fetch)

    spark.dataSource.register(Posts)
