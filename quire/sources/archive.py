"""Image archives as a Spark data source: one partition a query, answers fetched on the workers.

    spark.dataSource.register(ImageSearch)
    spark.read.format("image_search").option("archive", "wikimedia").option("queries", "a|b").option("limit", 10).load()

How an archive is asked is a function from (query, limit) to records, given by name in ``FETCHERS``; without a network the
stub answers from hashes of the query. A query that fails gives no rows, not a failed job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, ord int, title string, url string, license string, mime string, width int, height int"
#: Over-fetching: how many to ask for when n are wanted, and the archive's own bound.
OVER = {"loc": (3, 25), "wikimedia": (3, 30), "internet_archive": (2, 20), "pexels": (1, 80), "stub": (1, 50)}


def stub(query: str, limit: int) -> list[tuple]:
    """Made-up answers that depend on the query only."""
    out = []
    for i in range(limit):
        h = hashlib.md5(f"{query}/{i}".encode()).digest()
        lic = ("CC-BY-4.0", "Public domain", "All rights reserved", "", "CC BY-NC 2.0")[h[0] % 5]
        out.append((f"{query} {i}", f"http://example.org/{h.hex()[:12]}.jpg", lic, "image/jpeg" if h[1] % 4 else "image/gif", 100 * (h[2] % 20), 100 * (h[3] % 20)))
    return out


#: Archive -> function(query, limit) -> [(title, url, license, mime, width, height)].
FETCHERS: dict[str, Callable[[str, int], list[tuple]]] = {"stub": stub}


def over_fetch(archive: str, n: int) -> int:
    times, most = OVER.get(archive, (1, n))
    return min(times * n, most)


class _Query(InputPartition):
    def __init__(self, query: str) -> None:
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.queries = [q for q in options.get("queries", "").split("|") if q.strip()]
        self.archive, self.limit = options.get("archive", "stub"), int(options.get("limit", 3))
        self.fetch = FETCHERS.get(self.archive, stub)

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries] or [_Query("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.query:
            try:
                rows = self.fetch(partition.query, over_fetch(self.archive, self.limit))
            except Exception:
                rows = []
            for i, r in enumerate(rows):
                yield (partition.query, i, *r)


class ImageSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
