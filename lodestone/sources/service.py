"""Tables of a paged service that tells no total: it answers fetch(offset, limit) with rows and whether more follow.

In batch, a planning probe doubles the page until there is none and halves back, so a service of n pages costs
about 2 log2(n) requests before its pages are read side by side; the last partition goes on as long as the service
says that more follow. As a stream, offsets are numbers of rows, so a restart goes on where the checkpoint ends.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Fetch = Callable[[int, int], tuple[list[tuple], bool]]


class Unavailable(ConnectionError):
    """An answer of the 5xx kind, or 429: worth another try."""


@dataclass
class Asking:
    """How a service is asked: rows to a page, tries of a request, seconds before the second one (then doubled)."""

    fetch: Fetch
    size: int = 1000
    tries: int = 5
    pause: float = 0.5

    def page(self, offset: int, limit: int | None = None) -> tuple[list[tuple], bool]:
        for attempt in range(self.tries):
            try:
                return self.fetch(offset, limit or self.size)
            except ConnectionError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def length(self) -> int:
        """Rows that the service has now."""
        low, step = 0, 1
        rows, more = self.page(0)
        if not more:
            return len(rows)
        full = len(rows)
        while True:
            rows, more = self.page(step * self.size)
            if rows and not more:
                return step * self.size + len(rows)
            if not rows:
                break
            low, full, step = step, len(rows), 2 * step
        high = step
        while high - low > 1:
            at = (low + high) // 2
            rows, more = self.page(at * self.size)
            if rows and not more:
                return at * self.size + len(rows)
            low, high, full = (at, high, len(rows)) if rows else (low, at, full)
        return low * self.size + full


class Rows(InputPartition):
    """Rows from start on, before end; with no end, as long as more follow."""

    def __init__(self, start: int, end: int | None):
        self.start, self.end = start, end


def _read(asking: Asking, part: Rows) -> Iterator[tuple]:
    at = part.start
    while part.end is None or at < part.end:
        rows, more = asking.page(at, asking.size if part.end is None else min(asking.size, part.end - at))
        yield from rows
        at += len(rows)
        if not rows or (part.end is None and not more):
            return


class ServiceReader(DataSourceReader):
    def __init__(self, asking: Asking, pages_each: int):
        self.asking, self.step = asking, pages_each * asking.size

    def partitions(self) -> list[Rows]:
        starts = list(range(0, max(1, self.asking.length()), self.step))
        return [Rows(s, s + self.step) for s in starts[:-1]] + [Rows(starts[-1], None)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        return _read(self.asking, partition)


class ServiceStream(DataSourceStreamReader):
    """A service that has lost rows doesn't move the offset back."""

    def __init__(self, asking: Asking, pages_each: int):
        self.asking, self.step, self.latest = asking, pages_each * asking.size, 0

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        self.latest = max(self.latest, self.asking.length())
        return {"rows": self.latest}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        self.latest = max(self.latest, end["rows"])
        return [Rows(s, min(s + self.step, end["rows"])) for s in range(start["rows"], end["rows"], self.step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        return _read(self.asking, partition)


def service_source(source_name: str, columns: str, fetch: Fetch, size: int = 1000, pages_each: int = 10, tries: int = 5, pause: float = 0.5) -> type[DataSource]:
    """A data source over the service, for read and readStream; register it with spark.dataSource."""
    asking = Asking(fetch, size, tries, pause)

    class Service(DataSource):
        @classmethod
        def name(cls) -> str:
            return source_name

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> ServiceReader:
            return ServiceReader(asking, pages_each)

        def streamReader(self, schema) -> ServiceStream:
            return ServiceStream(asking, pages_each)

    return Service
