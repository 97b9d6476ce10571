"""Paged feeds as a Spark data source: a partition per range of pages, fetched by the tasks.

The driver asks for the first page only, for the total. Every page a task
fetches is held against that total and against what was asked for; what only
all pages together can tell (repeats, the number of rows) is told by an
aggregate over the landed rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wattlake.operators.graph import written
from wattlake.sources.feeds import redact

#: The most rows and pages of one feed.
MOST_ROWS, MOST_PAGES = 250_000, 1_000
SCHEMA = "offset long, page long, print string, row map<string,string>"

#: Takes offset and length, gives total and data (a list of records).
Fetch = Callable[[int, int], dict]


class Span(InputPartition):
    """Rows from ``start`` up to ``stop`` of a feed of ``total`` rows."""

    def __init__(self, start: int, stop: int, total: int):
        super().__init__((start, stop))
        self.start, self.stop, self.total = start, stop, total


def total_of(page: dict) -> int:
    """The page's total: a whole number, not negative, or an error."""
    raw = page.get("total")
    if isinstance(raw, bool) or raw is None or not str(raw).strip().isdigit():
        raise ValueError(f"total must be a whole number that is not negative: {raw!r}")
    return int(raw)


def checked(page: dict, asked: int, length: int, total: int) -> list[dict]:
    """A page's rows, if they are what was asked for."""
    rows = page.get("data")
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ValueError("unexpected response: data must be a list of records")
    if total_of(page) != total:
        raise ValueError(f"total changed from {total} to {total_of(page)}")
    if len(rows) > length:
        raise ValueError(f"page at {asked} has {len(rows)} rows of {length} asked for")
    if not rows and asked < total:
        raise ValueError(f"no progress at {asked} of {total}")
    return rows


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, length: int, span: int, most_rows: int, most_pages: int, secrets: tuple[str, ...]):
        self.fetch, self.length, self.span, self.most_rows, self.most_pages, self.secrets = fetch, length, span, most_rows, most_pages, secrets

    def _page(self, offset: int, length: int) -> dict:
        try:
            return self.fetch(offset, length)
        except Exception as e:
            raise ValueError(redact(f"{type(e).__name__} at {offset}: {e}", self.secrets)) from None

    def partitions(self) -> list[Span]:
        total = total_of(self._page(0, self.length))
        if total > self.most_rows:
            raise ValueError(f"{total} rows are more than {self.most_rows}")
        if -(-total // self.length) > self.most_pages:
            raise ValueError(f"over {self.most_pages} pages")
        step = self.length * self.span
        return [Span(a, min(a + step, total), total) for a in range(0, total, step)] or [Span(0, 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        at = partition.start
        if partition.stop == 0:
            if self._page(0, self.length).get("data"):
                raise ValueError("total is zero but rows were returned")
            return
        while at < partition.stop:
            length = min(self.length, partition.stop - at)
            rows = checked(self._page(at, length), at, length, partition.total)
            mark = hashlib.sha256(json.dumps(rows, sort_keys=True, default=str).encode()).hexdigest()
            for i, r in enumerate(rows):
                yield at + i, at, mark, {str(k): None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in r.items()}
            at += len(rows)


def paged_source(name: str, fetch: Fetch, length: int, span: int, most_rows: int, most_pages: int, secrets: tuple[str, ...]) -> type[DataSource]:
    """A data source of one feed; its fetcher travels with the class, so no secret is an option of a plan."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(fetch, length, span, most_rows, most_pages, secrets)

    return Paged


def read_paged(spark: SparkSession, fetch: Fetch, length: int = 5000, span: int = 4, most_rows: int = MOST_ROWS, most_pages: int = MOST_PAGES, secrets: tuple[str, ...] = ()) -> DataFrame:
    """``row`` (name to text) of every record of a feed, landed once in the shared folder, and its ``offset``.

    ``fetch`` must be safe to call in tasks and again after a failure. A total
    that changes, even between partitions, a page that repeats, one that is
    empty or too long, and more rows or pages than allowed raise; secrets never
    reach a message. A feed without rows gives none.
    """
    name = f"paged_{uuid.uuid4().hex}"
    spark.dataSource.register(paged_source(name, fetch, length, span, most_rows, most_pages, secrets))
    rows = written(spark.read.format(name).load())
    per_page = rows.groupBy("print", "page").agg(F.count(F.lit(1)).alias("n"))
    again = per_page.groupBy("print").agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("page")).where("pages > 1").orderBy("page").first()
    if again is not None:
        raise ValueError(f"page at {again['page']} repeats")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("d"), F.max("offset").alias("last")).first()
    if seen["n"] != seen["d"] or seen["n"] and seen["last"] + 1 != seen["n"]:
        raise ValueError(f"{seen['n']} rows at {seen['d']} places up to {seen['last']}")
    return rows.select("offset", "row")


def numbered(fetch_page: Callable[[int, int], list], size: int) -> Fetch:
    """A fetcher for feeds that count pages of ``size`` rows from 1 and give a pair of page data (with ``total``) and rows.

    ``fetch_page`` takes the page's number and size; where fewer rows are asked for, they are cut from the page.
    """

    def fetch(offset: int, length: int) -> dict:
        meta, rows = fetch_page(offset // size + 1, size)
        return {"total": meta["total"], "data": (rows or [])[offset % size :][:length]}

    return fetch
