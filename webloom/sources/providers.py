"""Where live systems plug in: a source of pages and a sink of events, as Spark data sources; they hold no network code themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class FetchReader(DataSourceReader):
    def __init__(self, urls: list[str], parts: int, fetch: Callable[[str], tuple]):
        self.urls, self.parts, self.fetch = urls, max(1, parts), fetch

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[k :: self.parts]) for k in range(self.parts) if self.urls[k :: self.parts]]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield self.fetch(url)


class PageSource(DataSource):
    """Raw pages of the urls in option ``urls`` (a line each), fetched by ``fetch``, which a subclass supplies: url to (url, html, status_code)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string, status_code int"

    @staticmethod
    def fetch(url: str) -> tuple:
        raise NotImplementedError("a subclass fetches")

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FetchReader(self.options.get("urls", "").split(), int(self.options.get("parts", "8")), self.fetch)


def fetched(urls: DataFrame, source: type[PageSource], parts: int | None = None) -> DataFrame:
    """The pages of a table's urls (url), fetched on the executors by ``source``: however many there are, none goes through the driver or an option. With ``parts`` the
    urls are dealt to so many tasks. A null url: no page. Repeated urls: fetched each."""
    fetch, schema = source.fetch, source({}).schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fetch(u) for u in batch.column(0).to_pylist()]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["url", "html", "status_code"])

    asked = urls.select("url").where("url IS NOT NULL")
    return (asked if parts is None else asked.repartition(parts)).mapInArrow(run, schema)


class _Asked(InputPartition):
    def __init__(self, queries: list[tuple[int, str]]):
        self.queries = queries


class SearchReader(DataSourceReader):
    def __init__(self, source: SearchSource, queries: list[str], parts: int, kind: str, limit: int):
        self.source, self.kind, self.limit, self.parts = source, kind, limit, max(1, parts)
        self.asked = list(enumerate(queries))

    def partitions(self) -> list[InputPartition]:
        return [_Asked(self.asked[k :: self.parts]) for k in range(self.parts) if self.asked[k :: self.parts]]

    def read(self, partition: _Asked) -> Iterator[tuple]:
        ask = {"web": self.source.search_web, "images": self.source.search_images, "news": self.source.search_news}[self.kind]
        for number, query in partition.queries:
            yield number, self.source.name(), self.kind, ask(query, self.limit)


class SearchSource(DataSource):
    """Answers of a search provider to the queries in option ``queries`` (a line each), in the shape that ``operators.search.items`` reads: search (the query's number),
    provider, source, body (the provider's JSON). A subclass names the provider, says whether it can be asked, and asks it; option ``source`` is web,
    images or news, option ``limit`` how many results are wanted. A provider that cannot be asked answers nothing."""

    @classmethod
    def name(cls) -> str:
        return "search"

    @staticmethod
    def is_available() -> bool:
        return False

    @staticmethod
    def search_web(query: str, limit: int) -> str:
        raise NotImplementedError("a subclass asks")

    search_images = search_news = search_web

    def schema(self) -> str:
        return "search long, provider string, source string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        queries = [q for q in self.options.get("queries", "").split("\n") if q.strip()] if self.is_available() else []
        return SearchReader(self, queries, int(self.options.get("parts", "4")), self.options.get("source", "web"), int(self.options.get("limit", "5")))
