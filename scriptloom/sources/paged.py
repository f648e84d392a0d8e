"""Paged feeds as a Spark data source: pages are partitions, fetched again with growing waits when they fail.

A feed is a folder of recorded pages, JSON files named page-<number>.json with a list of items each, as an interface that
gives results page by page would give them (`record` writes such folders). How a page is fetched is a class of its own, so
another transport takes its place without a change here. Filters on `keyword` (equality) and `published` (bounds) go to the
reader, which skips items before they reach Spark and pages whose range of times, kept in the folder's index, is outside.
Each page tells the tries that it took, so that the statistics of retries come from the same read.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .samples import backoff

FIELDS = ("id", "keyword", "source", "published", "content")
SCHEMA = "id long, keyword string, source string, published string, content string, page int, tries int"


class PageError(Exception):
    """A page couldn't be had this time."""


class FolderTransport:
    """Pages from a folder that all executors share. A page with a file fail-<number> of n fails n times for each reader,
    as tests of retries need it."""

    def __init__(self, folder: str):
        self.folder = Path(folder.removeprefix("file://").removeprefix("file:"))

    def index(self) -> list[dict]:
        return json.loads((self.folder / "index.json").read_text(encoding="utf-8"))

    def fetch(self, page: int, attempt: int) -> list[dict]:
        failing = self.folder / f"fail-{page}"
        if failing.exists() and attempt < int(failing.read_text()):
            raise PageError(f"page {page}, try {attempt + 1}")
        with (self.folder / f"page-{page}.json").open(encoding="utf-8") as lines:
            return [json.loads(x) for x in lines]


@dataclass
class Pages(InputPartition):
    """Consecutive pages."""

    numbers: list[int]


@dataclass
class Wanted:
    keyword: str | None = None
    low: str | None = None
    high: str | None = None
    above: bool = False
    below: bool = False

    def has(self, item: dict) -> bool:
        if self.keyword is not None and item.get("keyword") != self.keyword:
            return False
        at = item.get("published")
        if (self.low is not None or self.high is not None) and at is None:
            return False
        return not (self.low is not None and (at < self.low or self.above and at == self.low) or self.high is not None and (at > self.high or self.below and at == self.high))

    def may(self, page: dict) -> bool:
        """Whether a page of the index can have such items."""
        if (self.low is not None or self.high is not None) and page["first"] is None:
            return False
        return not (self.low is not None and page["last"] < self.low or self.high is not None and page["first"] > self.high) and (self.keyword is None or self.keyword in page["keywords"])


class Feed:
    """What both readers share."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.per_task = int(options.get("pagesPerTask", 4))
        self.retries, self.wait, self.factor = int(options.get("maxRetries", 3)), float(options.get("initialDelay", 1.0)), float(options.get("backoffFactor", 2.0))
        self.wanted = Wanted()

    def deal(self, pages: list[dict]) -> list[Pages]:
        numbers = [p["page"] for p in pages if self.wanted.may(p)]
        return [Pages(numbers[i : i + self.per_task]) for i in range(0, len(numbers), self.per_task)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        transport = FolderTransport(self.folder)
        for page in partition.numbers:
            for attempt in range(self.retries + 1):
                try:
                    items = transport.fetch(page, attempt)
                    break
                except PageError:
                    if attempt == self.retries:
                        raise
                    time.sleep(backoff(attempt, self.wait, self.factor))
            for item in items:
                if self.wanted.has(item):
                    yield (*(item.get(f) for f in FIELDS), page, attempt + 1)


class FeedReader(Feed, DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            w = self.wanted
            if name == "keyword" and isinstance(f, EqualTo) and w.keyword in (None, value):
                w.keyword = value
            elif name == "published" and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and w.low is None:
                w.low, w.above = value, isinstance(f, GreaterThan)
            elif name == "published" and isinstance(f, (LessThan, LessThanOrEqual)) and w.high is None:
                w.high, w.below = value, isinstance(f, LessThan)
            else:
                yield f

    def partitions(self):
        return self.deal(FolderTransport(self.folder).index()) or [Pages([])]


class FeedStream(Feed, DataSourceStreamReader):
    """Offsets are page numbers: pages that the index has got since the last batch are the next one."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": 1 + max((p["page"] for p in FolderTransport(self.folder).index()), default=-1)}

    def partitions(self, start: dict, end: dict):
        return self.deal([p for p in FolderTransport(self.folder).index() if start["page"] <= p["page"] < end["page"]])

    def commit(self, end: dict) -> None:
        pass


class PagedFeed(DataSource):
    """spark.read.format("paged_feed").option("path", folder); also as a stream. Options: pagesPerTask, maxRetries,
    initialDelay (seconds) and backoffFactor."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def record(items: DataFrame, folder: str, size: int = 100) -> None:
    """Writes items (id, keyword, source, published, content) as pages of about `size`, in order of the id, and their index;
    recorded again, the pages and the index grow. A task writes the pages of its range, each whole."""
    spark = items.sparkSession
    root = Path(folder.removeprefix("file://").removeprefix("file:"))
    root.mkdir(parents=True, exist_ok=True)
    old = FolderTransport(folder).index() if (root / "index.json").exists() else []
    start = 1 + max((p["page"] for p in old), default=-1)
    rows = items.select(*FIELDS)
    parts = max(1, -(-rows.count() // size))

    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        number = start + TaskContext.get().partitionId()
        found = [x for b in batches for x in b.to_dict("records")]
        if found:
            part = root / f".page-{number}.{TaskContext.get().taskAttemptId()}"
            part.write_text("".join(json.dumps({k: None if v != v else v for k, v in x.items()}) + "\n" for x in found), encoding="utf-8")
            part.rename(root / f"page-{number}.json")
            times = [x["published"] for x in found if x["published"] is not None]
            yield pd.DataFrame({"page": [number], "first": [min(times, default=None)], "last": [max(times, default=None)], "keywords": [sorted({x["keyword"] for x in found if x["keyword"] is not None})]})

    made = rows.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInPandas(write, "page int, first string, last string, keywords array<string>").collect()  # a row a page
    index = old + sorted((r.asDict() for r in made), key=lambda p: p["page"])
    part = root / ".index"
    part.write_text(json.dumps(index), encoding="utf-8")
    part.rename(root / "index.json")


def retry_figures(rows: DataFrame) -> DataFrame:
    """Pages, retries and pages that were had at once, by what was read."""
    pages = rows.groupBy("page").agg(F.max("tries").alias("tries"))
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("tries") - 1).alias("retries"), F.count_if(F.col("tries") == 1).alias("at_once"))
