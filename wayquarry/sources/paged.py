"""A Spark data source for paged services: a page is a partition, failed fetches are tried again.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").schema(...).options(url="https://host/items?limit={limit}&offset={offset}", total=5000).load()

url may name several servers, parted by |, which are tried in turn, or be a local pattern
(file:///folder/page-{page}.json) where pages were saved. ``parameters`` (JSON: column to the service's name for it) says which columns it can filter by itself: equalities with
them are put where url has {filters}, so that pages without wanted rows aren't fetched; Spark looks at them again, in case the service compares otherwise. total is a number, or where the first answer has it. A page is a JSON array, or an
object with the array under ``records`` (dots lead further in). Values are converted to the schema's types.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


@dataclass
class Page(InputPartition):
    number: int
    offset: int
    limit: int


def fetch(urls: list[str], attempts: int, wait: float) -> object:
    """The answer of the first server that gives one; attempts go round the servers."""
    for k in range(attempts):
        try:
            with urllib.request.urlopen(urls[k % len(urls)], timeout=60) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            if k + 1 == attempts:
                raise
            time.sleep(wait * 2 ** (k // len(urls)))
    raise ValueError("no attempt was allowed")


def value_as(kind: T.DataType, x: object) -> object:
    if x is None:
        return None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x, sort_keys=True, ensure_ascii=False)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(x)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(x)
    if isinstance(kind, T.ArrayType):
        return [value_as(kind.elementType, v) for v in x]
    if isinstance(kind, T.StructType):
        return tuple(value_as(f.dataType, x.get(f.name)) for f in kind.fields)
    return x


def _inside(found: object, path: str) -> object:
    for part in filter(None, path.split(".")):
        found = found[part]
    return found


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.kind, self.options = schema, dict(options)
        self.filters = ""

    def answer(self, page: Page) -> object:
        urls = [u.strip().format(limit=page.limit, offset=page.offset, page=page.number, filters=self.filters) for u in self.options["url"].split("|")]
        return fetch(urls, int(self.options.get("attempts", 4)), float(self.options.get("wait", 1.0)))

    def partitions(self) -> list[InputPartition]:
        limit, total = int(self.options.get("limit", 1000)), self.options.get("total", "1")
        if not total.isdigit():  # the first answer says how many there are
            total = _inside(self.answer(Page(0, 0, limit)), total)
        return [Page(k, at, limit) for k, at in enumerate(range(0, int(total), limit))]

    def read(self, partition: Page) -> Iterator[tuple]:
        for x in _inside(self.answer(partition), self.options.get("records", "")):
            yield tuple(value_as(f.dataType, x.get(f.name)) for f in self.kind.fields)


class FilteredReader(PagedReader):
    """Pages of a service that filters; needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        known = json.loads(self.options["parameters"])
        own = {known[f.attribute[0]]: f.value for f in filters if isinstance(f, EqualTo) and f.attribute[0] in known}
        self.filters = "".join("&" + urllib.parse.urlencode({name: value}) for name, value in own.items())
        return filters


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (FilteredReader if "parameters" in self.options else PagedReader)(schema, self.options)
