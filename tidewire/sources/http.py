"""Bodies over HTTP under limits of bytes and time, with redirects checked hop by hop; as a function and as a Spark data source.

A failure is a row with a fixed reason, never an error of the job: one bad source adds nothing and stops nothing.
"""

from __future__ import annotations

import http.client
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire import config as C

#: Seconds for one source in all, redirects at most.
SECONDS, HOPS = 8.0, 5


@dataclass(frozen=True)
class Answer:
    status: int | None
    content_type: str | None
    body: str | None
    reason: str | None


def fetch(url: str, max_bytes: int = C.BODY_BYTES, seconds: float = SECONDS, hops: int = HOPS, schemes: tuple[str, ...] = ("https",)) -> Answer:
    """The body of a URL. Redirects stay on the first host and on allowed schemes; the time limit holds for connection, headers and body together."""
    until, first = time.monotonic() + seconds, urlsplit(url).netloc.lower()
    for _ in range(hops + 1):
        at = urlsplit(url)
        if at.scheme not in schemes or at.netloc.lower() != first or not first:
            return Answer(None, None, None, "redirect")
        left = until - time.monotonic()
        if left <= 0:
            return Answer(None, None, None, "timeout")
        kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
        link = kind(at.netloc, timeout=left)
        try:
            link.request("GET", (at.path or "/") + (f"?{at.query}" if at.query else ""), headers={"User-Agent": "tidewire", "Accept-Encoding": "identity"})
            answer = link.getresponse()
            if answer.status in (301, 302, 303, 307, 308) and answer.headers.get("Location"):
                url = urljoin(url, answer.headers["Location"])
                continue
            got = bytearray()
            while piece := answer.read1(65536):
                got += piece
                if len(got) > max_bytes:
                    return Answer(answer.status, None, None, "size")
                if time.monotonic() > until:
                    return Answer(answer.status, None, None, "timeout")
            return Answer(answer.status, answer.headers.get("Content-Type"), bytes(got).decode("utf-8", "replace"), None)
        except TimeoutError:
            return Answer(None, None, None, "timeout")
        except (OSError, http.client.HTTPException, ValueError):
            return Answer(None, None, None, "network")
        finally:
            link.close()
    return Answer(None, None, None, "redirect")


@dataclass
class _Source(InputPartition):
    source_id: str
    url: str
    max_bytes: int


class _Reader(DataSourceReader):
    def __init__(self, sources: list[dict], seconds: float, schemes: tuple[str, ...]):
        self.sources, self.seconds, self.schemes = sources, seconds, schemes

    def partitions(self) -> list[_Source]:
        return [_Source(s["source_id"], s["url"], s.get("max_body_bytes") or C.BODY_BYTES) for s in self.sources]

    def read(self, partition: _Source) -> Iterator[tuple]:
        a = fetch(partition.url, partition.max_bytes, self.seconds, schemes=self.schemes)
        yield (partition.source_id, a.status, a.content_type, a.body, a.reason)


class FeedHttp(DataSource):
    """`spark.read.format("feed_http")`: a row (source_id, status, content_type, body, reason) of each source, each in a task of its own.

    Options: `sources`, a JSON list of objects with source_id, url and perhaps max_body_bytes (the catalogue by default), `seconds` and `schemes`.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_http"

    def schema(self) -> str:
        return "source_id string, status int, content_type string, body string, reason string"

    def reader(self, schema) -> DataSourceReader:
        given = self.options.get("sources")
        return _Reader(json.loads(given) if given else C.sources(), float(self.options.get("seconds", SECONDS)), tuple(self.options.get("schemes", "https").split(",")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedHttp)
