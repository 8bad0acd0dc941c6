"""Paged logs as a Spark stream: polls of overlapping windows of time, each read page by page in a task of its own.

The offset is the number of windows that are over. A batch is the windows between two offsets, so a batch that is run again reads the same
ones; what overlapping windows bring twice is for the reader to drop by key. A window that can't be read is a row, not an error.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewire import config as C
from tidewire.sources.capture import read_pages
from tidewire.sources.http import fetch

#: Name of a window's first page where pages are files.
FIRST = "first"


@dataclass
class _Window(InputPartition):
    start: int
    end: int


def _ms(said: str) -> int | None:
    """Milliseconds of a moment as text, in milliseconds or by ISO 8601."""
    if said.lstrip("-").isdigit():
        return int(said)
    try:
        at = datetime.fromisoformat(said)
    except ValueError:
        return None
    return round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        number = lambda name, default=None: int(options[name]) if name in options else default
        self.pages, self.start, self.every = options["pages"].rstrip("/"), number("startms"), number("intervalms", 600_000)
        self.long, self.until, self.most = number("windowms", self.every), number("untilms"), number("maxpages", C.POLL_PAGES)
        if self.start is None or self.every <= 0 or self.long < self.every:
            raise ValueError("startMs is to be given, and a window is to be as long as the interval at least")

    def initialOffset(self) -> dict:
        return {"window": 0}

    def latestOffset(self) -> dict:
        now = time.time() * 1000 if self.until is None else self.until
        return {"window": max(0, int((now - self.start - self.long) // self.every) + 1)}

    def partitions(self, start: dict, end: dict) -> list[_Window]:
        return [_Window(at := self.start + k * self.every, at + self.long) for k in range(start["window"], end["window"])]

    def _page(self, window: _Window, cursor: str | None) -> str:
        if self.pages.startswith(("http://", "https://")):
            a = fetch(f"{self.pages}?from={window.start}&to={window.end}" + (f"&cursor={cursor}" if cursor else ""), schemes=("http", "https"))
            if a.reason or a.status != 200:
                raise TimeoutError(a.reason) if a.reason == "timeout" else OSError(a.reason or a.status)
            return a.body or ""
        files, at = fs.FileSystem.from_uri(f"{self.pages}/from_ms={window.start}/page={cursor or FIRST}")
        found = sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.base_name[0] not in "._")
        return "\n".join(files.open_input_stream(f).read().decode("utf-8", "replace") for f in found)

    def read(self, partition: _Window) -> Iterator[tuple]:
        start, end = partition.start, partition.end
        row = lambda kind, value=None, a=None, b=None, reason=None: (start, end, kind, value, a, b, reason)
        try:
            lines, gaps = read_pages(lambda cursor: self._page(partition, cursor), str(start), str(end), self.most)
        except OSError as e:  # a timeout is one too
            yield row("poll", "failed")
            yield row("gap", None, start, end, "timeout" if isinstance(e, TimeoutError) else "cli-exit")
            return
        yield row("poll", "ok")
        for line in lines:
            yield row("line", line)
        for a, b, reason in gaps:
            a, b = _ms(a), _ms(b)
            yield row("gap", None, start if a is None else a, end if b is None else b, reason)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: pages stay where they are."""


class PagedLogs(DataSource):
    """`spark.readStream.format("paged_logs")`: rows (from_ms, to_ms, kind, value, gap_from, gap_to, reason) of polls.

    kind is poll (value ok or failed), line (value the line) or gap (what the poll couldn't read, and why: cli-exit, timeout, excluded, truncated).
    Options: `pages`, an http(s) URL that is asked with from, to and cursor, or a folder of pages `from_ms=.../page=<cursor>` by the URI of a file system
    that Arrow reads; `startMs`, `intervalMs`, `windowMs` (overlapping if longer than the interval), `maxPages` of a poll, and `untilMs` in place of the clock.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_logs"

    def schema(self) -> str:
        return "from_ms long, to_ms long, kind string, value string, gap_from long, gap_to long, reason string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedLogs)
