"""Versions of dimensions, and paged logs as a stream."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewire.operators import dimensions as D
from tidewire.plans.store import new_path
from tidewire.sources import paged

H = 3_600_000


def test_refreshes_once_a_cadence_and_again_after_a_failure(spark):
    rows = [("kev", 0, False), ("kev", 5, True), ("kev", 6, True), ("kev", 6 * H - 1, True), ("kev", 6 * H, True), ("epss", H, True), ("epss", 2 * H - 1, True), ("epss", 2 * H, None), ("edition", 900_000, True), ("edition", 1_799_999, True), ("other", 1, True), (None, 1, True)]
    out = D.refreshes(spark.createDataFrame(rows, "dimension string, at_ms long, ok boolean")).collect()
    assert sorted(tuple(r) for r in out) == [("edition", 900_000), ("epss", H), ("kev", 5), ("kev", 6 * H)]


def test_as_of_is_the_newest_not_after(spark):
    r = random.Random(1)
    versions = [(d, r.randrange(1000) * H) for d in ("kev", "epss") for _ in range(60)] + [("ssvc", 500 * H)]
    clocks = [(d, r.randrange(-20, 1200) * H) for d in ("kev", "epss", "ssvc", "edition") for _ in range(200)] + [("kev", versions[0][1])] * 3
    out = D.as_of(spark.createDataFrame(clocks, "dimension string, clock_ms long"), spark.createDataFrame(versions, "dimension string, version_ms long")).collect()
    want = []
    for d, at in clocks:
        v = max((m for e, m in versions if e == d and m <= at), default=None)
        want.append((d, at, v, None if v is None else at - v, "unavailable" if v is None else "ok" if at - v <= D.MAX_AGE[d] else "stale"))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert D.as_of(spark.createDataFrame([], "dimension string, clock_ms long"), spark.createDataFrame(versions, "dimension string, version_ms long")).count() == 0


def test_a_stale_catalogue_is_used_and_a_missing_one_is_a_state(spark):
    rows = spark.createDataFrame([("kev", 0, "A", None, None), ("epss", 90 * H, "A", 0.5, None), ("epss", 90 * H, "B", 0.1, None), ("ssvc", 90 * H, "B", None, "poc"), ("ssvc", 90 * H, "A", None, "active")], "dimension string, version_ms long, cve string, score double, exploitation string")
    clocks = spark.createDataFrame([(d, at) for d in ("kev", "epss", "ssvc") for at in (-1, 80 * H, 91 * H)], "dimension string, clock_ms long")
    at = D.as_of(clocks, rows.select("dimension", "version_ms").distinct())
    assert {(r["clock_ms"] // H, r["state"]) for r in at.where("dimension = 'kev'").collect()} == {(-1, "unavailable"), (80, "stale"), (91, "stale")}
    out = {(r["clock_ms"] // H, r["cve"]): tuple(r)[2:] for r in D.states_at(spark.createDataFrame([("A",), ("B",)], "cve string"), at, rows).collect()}
    none = "unavailable"
    assert out[(-1, "A")] == (none, none, None, none) and out[(80, "A")] == ("listed", none, None, "skipped") and out[(80, "B")] == ("not-listed", none, None, none)
    assert out[(91, "A")] == ("listed", "scored", 0.5, "skipped") and out[(91, "B")] == ("not-listed", "scored", 0.1, "assessed")


# ---- paged logs ----


def page(rows, following=None, **more):
    said = {"type": "summary", "pagination": {"hasMore": following is not None, "next": following}, **more}
    return "\n".join([*(json.dumps({"type": "log", "id": k}) for k in rows), json.dumps(said)])


def land(path, start, pages):
    """Pages of a window by their cursors."""
    for cursor, text in pages.items():
        at = Path(path.removeprefix("file://")) / f"from_ms={start}" / f"page={cursor}"
        at.mkdir(parents=True)
        (at / "part-0.txt").write_text(text)


def polled(spark, path, until, out, check, fail=False, most=20):
    paged.register(spark)
    rows = spark.readStream.format("paged_logs").option("pages", path).option("startMs", 0).option("intervalMs", 100).option("windowMs", 150).option("untilMs", until).option("maxPages", most).load()

    def take(batch, number):
        if fail:
            raise OSError("killed")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(take).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def test_polls_lose_and_double_nothing_when_killed(spark):
    path, out, check = (new_path(spark, n) for n in ("pages", "polls", "check"))
    land(path, 0, {"first": page([1, 2], "x"), "x": page([3])})
    land(path, 100, {"first": page([3, 4], None, excludedIntervals=[{"start": "1970-01-01T00:00:00.120Z"}, {"end": "170"}])})
    land(path, 300, {"first": page([6], "gone")})
    polled(spark, path, 250, out, check)
    with pytest.raises(StreamingQueryException):
        polled(spark, path, 460, out, check, fail=True)  # two more windows; nothing of them is written
    polled(spark, path, 560, out, check)  # what was planned before
    rows = polled(spark, path, 560, out, check)  # and what is new
    ids = rows.where("kind = 'line'").select(F.get_json_object("value", "$.id").alias("id")).where("id is not null")
    assert sorted(int(r["id"]) for r in ids.collect()) == [1, 2, 3, 3, 4]  # 3 is in both windows, for the reader to drop
    assert {(r["from_ms"], r["value"]) for r in rows.where("kind = 'poll'").collect()} == {(0, "ok"), (100, "ok"), (200, "failed"), (300, "failed"), (400, "failed")}
    gaps = sorted((r["gap_from"], r["gap_to"], r["reason"]) for r in rows.where("kind = 'gap'").collect())
    assert gaps == [(100, 170, "excluded"), (120, 250, "excluded"), (200, 350, "cli-exit"), (300, 450, "cli-exit"), (400, 550, "cli-exit")]


def test_a_poll_of_too_many_pages_is_truncated(spark):
    path, out, check = (new_path(spark, n) for n in ("pages", "polls", "check"))
    land(path, 0, {"first": page([1], "b"), "b": page([2], "c"), "c": page([3])})
    rows = polled(spark, path, 150, out, check, most=2)
    assert [(r["gap_from"], r["gap_to"], r["reason"]) for r in rows.where("kind = 'gap'").collect()] == [(0, 150, "truncated")]
    assert rows.where("kind = 'line'").count() == 4


def test_pages_over_http(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            body = page([int(q["from"])], None if "cursor" in q else "more").encode()
            self.send_response(500 if q["from"] == "100" else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = polled(spark, f"http://127.0.0.1:{server.server_port}/logs", 350, *(new_path(spark, n) for n in ("polls", "check")))
    finally:
        server.shutdown()
    assert {(r["from_ms"], r["value"]) for r in rows.where("kind = 'poll'").collect()} == {(0, "ok"), (100, "failed"), (200, "ok")}
    assert rows.where("value like '%log%'").count() == 4


def test_options_of_the_source():
    with pytest.raises(ValueError):
        paged.PagedLogs({"pages": "file:///x"}).streamReader(None)
    r = paged.PagedLogs({"pages": "file:///x", "startMs": "1000", "intervalMs": "10", "untilMs": "999"}).streamReader(None)
    assert r.latestOffset() == {"window": 0} and [(w.start, w.end) for w in r.partitions({"window": 2}, {"window": 4})] == [(1020, 1030), (1030, 1040)]
    assert paged._ms("12") == 12 and paged._ms("1970-01-01T00:00:01+00:00") == 1000 and paged._ms("soon") is None
