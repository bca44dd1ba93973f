"""Search connectors as a Python data source over landed answers: one partition for each query and page, in batch or as a stream.

An answer lands in slot=<n>/request=<key> as lines of JSON {attempt, status, body}: what each try of a request got. Slots are the
half-hours of the rotation, and what a stream counts its offsets in. A request is tried again, up to three times, if it got no
answer or one of 500 and above; any other answer that isn't a success is an error, as is a page that can't be read."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..functions.text import clean_title, normalize
from .landed import rotation

SCHEMA = "slot int, query string, page int, ordinal int, title string, link string, originallink string, description string, pub_date string, source string"
FORMAT = "news_search"
#: Service: (largest page, name of the list, fields of an item in the order title, link, original link, description, date, source).
SERVICES = {
    "naver": (100, "items", ("title", "link", "originallink", "description", "pubDate"), "NAVER"),
    "kakao": (50, "documents", ("title", "url", "url", "contents", "datetime"), "KAKAO"),
}


class SearchError(RuntimeError):
    """A request that has no usable answer."""


def page_size(service: str, size: int) -> int:
    return min(max(size, 1), SERVICES[service][0])


def request_key(service: str, query: str, page: int, size: int) -> str:
    """A name for the request of a page (from 1): the first service counts results, the second one pages."""
    size = page_size(service, size)
    at = f"&display={size}&sort=date&start={(page - 1) * size + 1}" if service == "naver" else f"&size={size}&sort=recency&page={page}"
    return hashlib.sha256(f"{service}?query={query}{at}".encode()).hexdigest()


def request_key_c(service: str, query: Column, page: Column, size: int) -> Column:
    """request_key() as a column."""
    size = page_size(service, size)
    at = (F.lit(f"&display={size}&sort=date&start="), (page - 1) * size + 1) if service == "naver" else (F.lit(f"&size={size}&sort=recency&page="), page)
    return F.sha2(F.concat(F.lit(f"{service}?query="), query, at[0], at[1].cast("string")), 256)


def answered(fetch: Callable[[int], tuple[int, object]], attempts: int = 3, backoff_ms: int = 250, sleep=time.sleep) -> tuple[int, object]:
    """(status, body) of the first try that isn't worth another one: tries go on after time-outs and statuses of 500 and above,
    each waiting twice as long as the one before. fetch(n) is the n-th try; another error of the last try is raised."""
    last = 0
    for n in range(attempts):
        try:
            last, body = fetch(n)
            if last < 500:
                return last, body
        except TimeoutError:
            pass
        except OSError:
            if n == attempts - 1:
                raise
        if n < attempts - 1 and backoff_ms:
            sleep(backoff_ms / 1000 * 2**n)
    raise SearchError(f"search answered {last or 'nothing in time'} in {attempts} tries")


def _files(path: str):
    import pyarrow.fs as fs

    local = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{local}")


def _slots(path: str) -> list[int]:
    import pyarrow.fs as fs

    system, root = _files(path)
    return sorted(int(f.base_name[5:]) for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("slot="))


def _tries(path: str, slot: int, key: str) -> dict[int, dict]:
    import pyarrow.fs as fs

    system, root = _files(path)
    found = {}
    for f in system.get_file_info(fs.FileSelector(f"{root}/slot={slot}/request={key}", allow_not_found=True)):
        if not f.base_name.startswith(("_", ".")):
            with system.open_input_stream(f.path) as s:
                for line in s.read().decode().splitlines():
                    one = json.loads(line)
                    found[one["attempt"]] = one
    return found


@dataclass
class Page(InputPartition):
    slot: int
    query: str
    page: int

    def __init__(self, slot: int, query: str, page: int):
        super().__init__((slot, query, page))
        self.slot, self.query, self.page = slot, query, page


class _Search:
    """What batch and stream have in common."""

    def __init__(self, options: dict):
        self.path, self.service = options["path"], options.get("service", "naver")
        if self.service not in SERVICES:
            raise ValueError(f"no such service: {self.service}")
        self.size, self.pages, self.each = int(options.get("size", 5)), max(1, int(options.get("pages", 1))), int(options.get("each", 8))
        self.backoff = int(options.get("backoffms", 0))  # a landed answer doesn't change while one waits
        self.key = options.get("key", "")
        if self.service == "naver" and not self.key:
            raise ValueError("the search needs a key")
        self.queries: set[str] | None = None
        self.page_numbers: set[int] | None = None

    def plan(self, slots) -> list[Page]:
        """The second service answers nothing without a key."""
        if not self.key:
            return []
        ask = [(s, q, p) for s in slots for q in rotation(s, self.each) for p in range(1, self.pages + 1)]
        return [Page(*x) for x in ask if (self.queries is None or x[1] in self.queries) and (self.page_numbers is None or x[2] in self.page_numbers)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # what Spark hands over where nothing is left to read
            return
        tries = _tries(self.path, partition.slot, request_key(self.service, partition.query, partition.page, self.size))

        def fetch(n: int) -> tuple[int, object]:
            if n not in tries:
                raise TimeoutError
            return tries[n]["status"], tries[n]["body"]

        where = f"{self.service}, slot {partition.slot}, query {partition.query!r}, page {partition.page}"
        try:
            status, body = answered(fetch, backoff_ms=self.backoff)
        except SearchError as e:
            raise SearchError(f"{where}: {e}") from None
        if not 200 <= status < 300:
            raise SearchError(f"{where}: search answered {status}")
        _, name, fields, source = SERVICES[self.service]
        try:
            items = json.loads(body).get(name) or []
        except (ValueError, AttributeError, TypeError):
            raise SearchError(f"{where}: the answer can't be read") from None
        for i, item in enumerate(items):
            title, link, original, description, date = (str(item.get(f) or "") for f in fields)
            yield (partition.slot, partition.query, partition.page, i, clean_title(title), link, original, normalize(description), date, source)


class _Reader(_Search, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on query and page leaves pages out before anything is read."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("query",):
                self.queries = values if self.queries is None else self.queries & values
            elif values is not None and f.attribute == ("page",):
                self.page_numbers = values if self.page_numbers is None else self.page_numbers & values
            else:
                yield f

    def partitions(self) -> list[Page]:
        return self.plan(_slots(self.path))


class _Stream(_Search, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"slot": min(_slots(self.path), default=0)}

    def latestOffset(self) -> dict:
        return {"slot": max(_slots(self.path), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.plan(s for s in _slots(self.path) if start["slot"] <= s < end["slot"])


class SearchSource(DataSource):
    """Options: path; service (naver, kakao); key; size (results a page, 1 to 100 or 50); pages (of each query); each (queries a
    slot); backoffMs."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)


def land(results: DataFrame, path: str, service: str, size: int, asked: DataFrame | None = None) -> None:
    """Lands results (slot, query, page, place, title, link, description, pub_date) as answers of the service, one a request.
    asked: (slot, query, page) of all requests, if some have no results: these get an answer without items."""
    _, name, fields, _ = SERVICES[service]
    columns = {"title": "title", "link": "link", "originallink": "link", "url": "link", "description": "description", "contents": "description", "pubDate": "pub_date", "datetime": "pub_date"}
    item = F.struct("place", *[F.col(columns[f]).alias(f) for f in dict.fromkeys(fields)])
    pages = results.groupBy("slot", "query", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))  # size rows at most
    if asked is not None:
        pages = asked.join(pages, ["slot", "query", "page"], "left").withColumn("items", F.coalesce("items", F.array().cast(pages.schema["items"].dataType)))
    body = F.to_json(F.struct(F.transform("items", lambda x: x.dropFields("place")).alias(name)))
    line = F.to_json(F.struct(F.lit(0).alias("attempt"), F.lit(200).alias("status"), body.alias("body")))
    pages.select("slot", request_key_c(service, F.col("query"), F.col("page"), size).alias("request"), line.alias("value")).write.mode("overwrite").partitionBy("slot", "request").text(path)
