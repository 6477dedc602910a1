"""A paged search service as a Python data source, for batches and for streams.

A reader first asks for the number of hits and then has one partition a page of them. Filters that the service can apply go into its query (`pushFilters`);
the others stay with Spark. Of the columns only those of the read's schema are asked for. `HttpClient` speaks the JSON of a search service (`from`, `size`, `_source`,
`query`, `sort`), `FileClient` reads JSON lines, a page by its place in the file, and applies no filter.

    paged.register(spark)
    spark.read.format("paged").schema("id string, type string").option("url", url).option("sort", "date desc").load().where("type = 'case'")

Options: `url` or `path`, `size` (rows a page, 100), `sort` (`field`, `field desc`; by comma), `terms.<field>` (values by comma: any of them, for fields that are lists, whose
filters Spark does not push), `tries` and `wait` of a request.

As a stream the offset is the number of rows that were listed; a batch is what came after the offset that the checkpoint has, so a run that was killed goes on there. The listing must
only grow at its end (sort by what new rows are last in).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

RANGES = {GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


class Page(InputPartition):
    def __init__(self, start: int, size: int, place: int = 0):
        super().__init__(start)
        self.start, self.size, self.place = start, size, place


class HttpClient:
    """A search service; a request that fails is tried again, after a wait that grows."""

    def __init__(self, url: str, tries: int = 3, wait: float = 1.0):
        self.url, self.tries, self.wait = url, tries, wait

    def ask(self, payload: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
        for n in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=30) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError):
                if n == self.tries:
                    raise
                time.sleep(n * self.wait)
        raise AssertionError("tries is below 1")

    def clause(self, f: Filter) -> dict | None:
        """The service's form of a filter, None if it has none."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name is None or isinstance(getattr(f, "value", ""), bool | float):
            return None
        if isinstance(f, EqualTo) and isinstance(f.value, str | int):
            return {"term": {name: f.value}}
        if isinstance(f, In) and all(isinstance(v, str | int) for v in f.value):
            return {"terms": {name: list(f.value)}}
        if type(f) in RANGES and isinstance(f.value, str | int):
            return {"range": {name: {RANGES[type(f)]: f.value}}}
        return {"exists": {"field": name}} if isinstance(f, IsNotNull) else None

    def _query(self, clauses: list[dict]) -> dict:
        return {"query": {"bool": {"must": clauses}}} if clauses else {}

    def count(self, clauses: list[dict]) -> int:
        return self.ask({"size": 0, "track_total_hits": True, **self._query(clauses)})["hits"]["total"]["value"]

    def pages(self, clauses: list[dict], size: int, start: int = 0, end: int | None = None) -> list[Page]:
        n = self.count(clauses) if end is None else end
        return [Page(i, min(size, n - i)) for i in range(start, n, size)]

    def fetch(self, page: Page, clauses: list[dict], fields: list[str], sort: list[dict]) -> Iterator[dict]:
        asked = {"from": page.start, "size": page.size, "_source": fields, **self._query(clauses)}
        for hit in self.ask(asked | ({"sort": sort} if sort else {}))["hits"]["hits"]:
            yield hit["_source"]


class FileClient:
    """JSON lines, in file order. The places of the pages are found once, and a page reads its own lines."""

    def __init__(self, path: str):
        self.path = path

    def clause(self, f: Filter) -> None:
        return None

    def count(self, clauses: list[dict]) -> int:
        with open(self.path, "rb") as f:
            return sum(1 for line in f if line.strip())

    def pages(self, clauses: list[dict], size: int, start: int = 0, end: int | None = None) -> list[Page]:
        out, n, place = [], 0, 0
        with open(self.path, "rb") as f:
            for line in f:
                if line.strip():
                    if start <= n and (end is None or n < end) and (n - start) % size == 0:
                        out.append(Page(n, size if end is None else min(size, end - n), place))
                    n += 1
                place += len(line)
        return out

    def fetch(self, page: Page, clauses: list[dict], fields: list[str], sort: list[dict]) -> Iterator[dict]:
        left = page.size
        with open(self.path, "rb") as f:
            f.seek(page.place)
            for line in f:
                if left == 0:
                    return
                if line.strip():
                    left -= 1
                    yield json.loads(line)


class Listing:
    """What readers of both kinds share: the client, the options and the form of a row."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.names, self.size = schema.names, int(options.get("size", "100"))
        self.client = HttpClient(options["url"], int(options.get("tries", "3")), float(options.get("wait", "1"))) if "url" in options else FileClient(options["path"])
        self.sort = [{field: {"order": (order or ["asc"])[0]}} for field, *order in (s.split() for s in options.get("sort", "").split(",") if s.strip())]
        self.clauses = [{"terms": {k[len("terms.") :]: v.split(",")}} for k, v in options.items() if k.startswith("terms.")]
        if isinstance(self.client, FileClient) and (self.sort or self.clauses):
            raise ValueError("a file has no query; filter and sort its rows with Spark")

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # a read without a page
            return
        for row in self.client.fetch(partition, self.clauses, self.names, self.sort):
            yield tuple(row.get(n) for n in self.names)


class PagedReader(Listing, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            clause = self.client.clause(f)
            if clause is None:
                yield f
            else:
                self.clauses.append(clause)

    def partitions(self) -> list[Page]:
        return self.client.pages(self.clauses, self.size)


class PagedStreamReader(Listing, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self.client.count(self.clauses)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.client.pages(self.clauses, self.size, start["rows"], end["rows"])

    def commit(self, end: dict) -> None:
        """Offsets live in the checkpoint; the service keeps nothing."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, titre string, text string, date string, source string, type string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        return PagedStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make format `paged` known, with filters pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
