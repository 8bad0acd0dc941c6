import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidewire.functions import metering as M
from tidewire.operators import budget as B
from tidewire.operators import enrich as N
from tidewire.operators import views as V
from tidewire.sources import http as H
from tidewire.sources import logs as L
from tidewire.sources import sinks as K


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/loop":
            self.send_response(302)
            self.send_header("Location", "/loop")
            self.end_headers()
        elif self.path in ("/hop", "/away"):
            self.send_response(301)
            self.send_header("Location", "/feed" if self.path == "/hop" else "http://other.invalid/")
            self.end_headers()
        elif self.path == "/slow":
            time.sleep(1.5)
        else:
            self.send_response(200 if self.path != "/gone" else 404)
            self.send_header("Content-Type", "application/rss+xml")
            self.end_headers()
            self.wfile.write(b"<rss/>" if self.path != "/big" else b"x" * 5000)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_fetch(site):
    get = lambda path, **k: H.fetch(site + path, schemes=("http",), **k)
    assert get("/feed") == H.Answer(200, "application/rss+xml", "<rss/>", None) == get("/hop")
    assert [get("/loop").reason, get("/away").reason, get("/big", max_bytes=100).reason, get("/slow", seconds=0.3).reason] == ["redirect", "redirect", "size", "timeout"]
    assert get("/gone").status == 404 and H.fetch(site + "/feed").reason == "redirect" and H.fetch("http://127.0.0.1:1/", schemes=("http",)).reason == "network"


def test_data_source(spark, site):
    H.register(spark)
    given = json.dumps([{"source_id": "a", "url": site + "/feed"}, {"source_id": "b", "url": site + "/big", "max_body_bytes": 9}, {"source_id": "c", "url": "no url"}])
    rows = spark.read.format("feed_http").option("sources", given).option("schemes", "http").load().collect()
    assert sorted((r["source_id"], r["body"], r["reason"]) for r in rows) == [("a", "<rss/>", None), ("b", None, "size"), ("c", None, "redirect")]


def test_metered():
    out = []
    assert M.metered("kev", lambda: 7, lambda v: {"n": v, "bytes": -1, "rcW": 1.6}, out.append) == 7
    row = json.loads(out[0].removeprefix("budget "))
    assert list(row) == ["p", "ok", "ms", "cpuMs", "n", "bytes", "rcW", "rcR", "kvCmd"] and (row["ok"], row["n"], row["bytes"], row["rcW"]) == (1, 7, 0, 2)
    with pytest.raises(KeyError):
        M.metered("ssvc", lambda: {}["x"], lambda v: {}, out.append)
    assert '"ok":0' in out[1] and out[1].endswith('"st":"failed"}')
    assert M.metered("kev", lambda: 1, lambda v: 1 / 0, out.append) == 1 and len(out) == 2


def test_summary_and_capture_rows(spark):
    lines = [
        {"type": "summary", "pagination": {"hasMore": True, "next": "c"}, "excludedIntervals": [{"start": "a"}, 5]}, {"type": "summary"}, {"type": "log"},
    ]
    got = [tuple(r) for r in L.summary_rows(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("x",)], "value string")).collect()]
    assert got[0][:2] == (True, "c") and [tuple(x) for x in got[0][2]] == [("a", None), (None, None)] and got[1] == (False, None, [])
    line = {"p": "kev", "ok": 1, "ms": 1, "cpuMs": 1, "n": 1, "bytes": 1, "rcW": 1, "rcR": 1, "kvCmd": 0}
    t = "2024-01-01T00:00:00Z"
    good = [{"k": "budget", "ts": t, "rid": "", "path": "", "dep": "", "line": line}, {"k": "req", "ts": t, "rid": "", "path": "", "route": "", "status": 200, "cache": "", "dep": ""}, {"k": "poll", "at": t, "from": t, "to": t, "ok": True, "runtime": 1, "requests": 0, "cli": "1"}, {"k": "gap", "from": t, "to": t, "reason": "timeout"}]
    bad = [{**good[0], "line": {**line, "ok": 3}}, {**good[1], "status": "200"}, {**good[2], "ok": 1}, {**good[3], "reason": "x"}, {**good[3], "from": "soon"}, {"k": "other"}, [], 5]
    rows = L.read_rows(spark.createDataFrame([(json.dumps(x),) for x in good + bad] + [("{",), ("  ",), ("",)], "value string")).collect()
    assert [r["valid"] for r in rows] == [True] * 4 + [False] * 9


def test_gap_rows(spark):
    kind = "stream string, from_ms long, to_ms long, ok boolean, failure string, truncated boolean, excluded array<struct<start:long,end:long>>"
    rows = [("s", 0, 10, True, None, False, []), ("s", 5, 15, False, "timeout", False, []), ("s", 30, 40, True, None, True, [(31, None)]), ("s", 35, 45, True, None, False, [])]
    assert sorted(tuple(r)[1:] for r in B.gap_rows(spark.createDataFrame(rows, kind), 10, 5).collect()) == [(5, 15, "timeout"), (10, 40, "missed-poll"), (30, 40, "truncated"), (31, 40, "excluded")]


def test_ssvc_answers(spark):
    cid = "CVE-2023-1234"
    none = json.dumps({"cveMetadata": {"cveId": cid}, "containers": {}})
    for status, body, late, want in ((200, none, False, "not-assessed"), (200, none, True, "unavailable"), (404, '{"error":"CVE_RECORD_DNE"}', False, "not-assessed"), (404, "{}", False, "unavailable"), (500, none, False, "unavailable"), (None, None, None, "unavailable")):
        (r,) = N.ssvc_answers(spark.createDataFrame([(cid, status, body, late)], "cve string, status int, body string, late boolean")).collect()
        assert r["state"] == want, (status, body, late)
    df = spark.createDataFrame([("assessed", "poc", "no", "total"), ("assessed", "poc", None, "total"), ("not-assessed", None, None, None), ("unavailable", "poc", "no", "total")], "s string, e string, a string, i string")
    assert [r[0] for r in df.select(N.cacheable(F.col("s"), F.col("e"), F.col("a"), F.col("i"))).collect()] == [True, False, True, False]


def test_steps_and_shown(spark):
    df = spark.createDataFrame([(-1, 3, True), (-1, 3, False), (2, 3, True), (0, 3, False), (1, 3, True), (0, 0, True)], "c int, n int, f boolean")
    assert [r[0] for r in df.select(V.step_index(F.col("c"), F.col("n"), F.col("f"))).collect()] == [0, 2, 2, 0, 2, -1]
    marks = spark.createDataFrame([(1, 5, "read", 3)], "user_id int, article_id int, kind string, at_ms int")
    seen = V.with_marks(spark.createDataFrame([(1, 5, "high"), (1, 6, "normal"), (1, 7, "critical")], "user_id int, id int, importance string"), marks)
    assert sorted(tuple(r) for r in V.mark_shown(seen, marks, V.visible(1, False, False), 9).collect()) == [(1, 5, "read", 3), (1, 7, "read", 9)]


def test_feed_response(spark):
    kind = "edition_pos long, title string, url string, summary string, source string, tier string, source_type string, section string, importance string, importance_reason string, cves array<string>, published_ms long"
    ed = spark.createDataFrame([(1, "a", "https://e/1", "", "S", "T", "news", "Breaches", "high", "Breach", [], 0)], kind)
    src = spark.createDataFrame([("S", "https://s")], "name string, url string")
    get = lambda slug, fmt: K.feed_response(ed, src, slug, fmt, 0, "https://x", "N", "D")
    assert get("nowhere", "xml")[0] == get("all", "txt")[0] == 404
    assert get("breaches", "xml")[2].count("<item>") == 1 and len(json.loads(get("high", "json")[2])["items"]) == 1
    assert get("critical", "xml")[0] == 200 and "<item>" not in get("critical", "xml")[2] and json.loads(get("critical", "json")[2])["items"] == []


def test_pages_of_a_poll():
    from tidewire.sources.capture import read_pages

    def page(n, more=True, **extra):
        return json.dumps({"type": "log", "n": n}) + "\n\n" + json.dumps({"type": "summary", "pagination": {"hasMore": more, "next": f"c{n + 1}"}, **extra}) + "\n"

    asked = []

    def read(cursor, last=2):
        asked.append(cursor)
        n = 0 if cursor is None else int(cursor[1:])
        return page(n, n < last, excludedIntervals=[{"start": "x"}, 5] if n == 1 else None)

    lines, gaps = read_pages(read, "a", "b")
    assert asked == [None, "c1", "c2"] and sum("log" in x for x in lines) == 3 and gaps == [("x", "b", "excluded"), ("a", "b", "excluded")]
    asked.clear()
    assert read_pages(lambda c: read(c, 99), "a", "b")[1][-1] == ("a", "b", "truncated") and len(asked) == 20
    assert read_pages(lambda c: "no json\n[1]\n", "a", "b") == (["no json", "[1]"], [])


def test_reads_and_captures(spark):
    df = spark.createDataFrame([(0, 0, 25, 10), (7, 120, 14, 10), (500, 900, 51, 10)], "s int, e int, w int, i int")
    got = [tuple(r) for r in df.select(B.render_reads(F.col("s"), F.col("e")), B.valid_capture(F.col("w"), F.col("i"))).collect()]
    assert got == [(2, True), (12, False), (112, False)]
    (url,) = spark.createDataFrame([("CVE-2024-1234",)], "c string").select(N.record_url(F.col("c"), "https://r.example")).first()
    assert url.startswith("https://r.example") and "CVE-2024-1234" in url
