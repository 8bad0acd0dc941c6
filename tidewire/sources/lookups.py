"""Look-ups of single records over HTTP, many at a time and all under one deadline."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.operators.enrich import record_url
from tidewire.plans.store import save
from tidewire.sources.http import Answer, fetch

# Seconds of all look-ups together, look-ups at a time.
SECONDS, WORKERS = 6.0, 12


def looked_up(ids: DataFrame, base: str, seconds: float = SECONDS, workers: int = WORKERS, tasks: int = 1, max_bytes: int = C.BODY_BYTES, schemes: tuple[str, ...] = ("https",)) -> DataFrame:
    """(cve, status, body, late) of each well-formed id (cve), once, for `ssvc_answers`: its record at `base`, asked by now.

    The ids are dealt to `tasks` tasks, each of which asks `workers` at a time, until one moment that holds for all: `seconds` from now, by the
    clocks of the executors. What has no answer by then is late, whether it was asked or not, and an answer that comes later changes nothing: the
    rows are written when this returns. A failed request has neither status nor body. A task that is run again has the time that is left.
    """
    until = time.time() + seconds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(url: str) -> Answer:
            return fetch(url, max_bytes, max(0.0, until - time.time()), schemes=schemes)

        def told(rows: list[tuple[str, Answer | None]]) -> pa.RecordBatch:
            late = [a is None or a.reason == "timeout" and time.time() >= until for _, a in rows]
            body = [None if gone else a.body for (_, a), gone in zip(rows, late, strict=True)]
            status = [None if gone else a.status for (_, a), gone in zip(rows, late, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()), pa.array(status, pa.int32()), pa.array(body, pa.string()), pa.array(late, pa.bool_())], names=["cve", "status", "body", "late"])

        pool, running = ThreadPoolExecutor(workers), {}

        def settled(most: int) -> list[tuple[str, Answer | None]]:
            """Answers until `most` look-ups at most are running, or the moment is there."""
            rows: list[tuple[str, Answer | None]] = []
            while len(running) > most and (left := until - time.time()) > 0:
                done: set[Future] = wait(running, timeout=left, return_when=FIRST_COMPLETED)[0]
                rows += [(running.pop(f), f.result()) for f in done]
            return rows

        try:
            for rb in batches:
                for cve, url in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                    if time.time() >= until:
                        yield told([(cve, None)])
                        continue
                    if rows := settled(workers - 1):
                        yield told(rows)
                    running[pool.submit(ask, url)] = cve
            yield told(settled(0))
            yield told([(cve, None) for cve in running.values()])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    asked = ids.select("cve").where(S.is_cve("cve")).distinct().select("cve", record_url(F.col("cve"), base).alias("url"))
    return save(asked.repartition(tasks, "cve").mapInArrow(run, "cve string, status int, body string, late boolean"), "looked-up")
