import json
import random

import pytest
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.operators import budget as B
from tidewire.operators import ranking
from tidewire.operators.ranking import dealt_in_order, medians, running_max
from tidewire.plans.store import fresh, new_path
from tidewire.sources import logs as L
from tidewire.sources import sinks as K
from tidewire.streaming import refresh as R

LINE = {"p": "edition", "ok": 1, "ms": 5, "cpuMs": 4, "n": 3, "bytes": 2, "rcW": 1, "rcR": 0, "kvCmd": 0}


def said(obj):
    return "budget " + json.dumps(obj, separators=(",", ":"))


GOOD = [said(LINE), said(LINE) + " \n", said({**LINE, "p": "ssvc", "st": "failed"})]
BAD = [
    "", "x" + said(LINE), said({**LINE, "p": "other"}), said({**LINE, "ok": 2}), said({**LINE, "ms": -1}), said({**LINE, "ms": 1.5}), said({**LINE, "ms": "1"}), said({**LINE, "x": 1}), said({k: LINE[k] for k in reversed(LINE)}), said({**LINE, "st": "failed"}),
    said({**LINE, "p": "ssvc"}), said({**LINE, "p": "ssvc", "st": "odd"}), "budget []", "budget {", said({**LINE, "n": 2**53}), None,
]


def test_lines(spark):
    df = spark.createDataFrame([(k, m) for k, m in enumerate(GOOD + BAD)], "k int, m string")
    out = [r["r"] for r in df.select("k", L.parse_line(F.col("m")).alias("r")).orderBy("k").collect()]
    assert all(r is not None for r in out[: len(GOOD)]) and [r for r in out[len(GOOD) :] if r] == []
    assert out[0].asDict() == {**LINE, "st": None} and out[2]["st"] == "failed"


def test_line_round_trip(spark):
    df = spark.createDataFrame([("ssvc", 1, 1.6, -3.0, "odd"), ("kev", 7, float("nan"), 2.0, None)], "p string, ok int, x double, y double, st string")
    numbers = {k: F.col("x" if k == "ms" else "y") for k in C.BUDGET_KEYS[2:]}
    out = df.select(L.format_line(F.col("p"), F.col("ok"), numbers, F.col("st")).alias("m")).withColumn("r", L.parse_line(F.col("m"))).collect()
    assert (out[0]["r"]["ms"], out[0]["r"]["n"], out[0]["r"]["st"], out[0]["r"]["ok"]) == (2, 0, "failed", 1)
    assert (out[1]["r"]["ms"], out[1]["r"]["n"], out[1]["r"]["st"], out[1]["r"]["ok"]) == (0, 2, None, 0)


def test_records(spark):
    data = {"timestamp": "2024-01-01T00:00:00Z", "requestId": "r", "requestPath": "/a?b=1", "deploymentId": 5, "message": said(LINE), "secret": "s", "httpStatus": 200, "route": "/a", "cacheResult": "HIT"}
    rows = [{"type": "log", "data": data}, {"type": "request", "data": data}, {"type": "log", "data": {**data, "message": "hello"}}, {"type": "request", "data": {**data, "httpStatus": "200"}}, {"type": "log", "data": []}, [], "x"]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("no json",), ("",)], "value string")
    (a,), (b,) = L.runtime_rows(lines).collect(), L.request_rows(lines).collect()
    assert (a["path"], a["dep"], a["line"]["bytes"]) == ("/a", "", 2) and "secret" not in a.asDict()
    assert (b["path"], b["status"], b["cache"]) == ("/a", 200, "HIT")


def polls(spark, *windows):
    return spark.createDataFrame([(k, "s", a, b) for k, (a, b) in enumerate(windows)], "pos int, stream string, from_ms long, to_ms long")


MIN = 60_000


def test_islands(spark):
    df = polls(spark, (0, 10 * MIN), (10 * MIN, 20 * MIN), (20 * MIN + 1, 30 * MIN), (5 * MIN, 7 * MIN), (200 * MIN, 190 * MIN), (None, 5), (59 * MIN, 130 * MIN), (100 * MIN, 125 * MIN), (130 * MIN, 131 * MIN), (140 * MIN, 140 * MIN))
    assert sorted((r["start"], r["stop"]) for r in B.islands(df).collect()) == [(0, 20 * MIN), (20 * MIN + 1, 30 * MIN), (59 * MIN, 131 * MIN)]
    assert sorted((r["start"], r["stop"]) for r in B.islands(df, (15 * MIN, 60 * MIN)).collect()) == [(15 * MIN, 20 * MIN), (20 * MIN + 1, 30 * MIN), (59 * MIN, 60 * MIN)]
    c = B.coverage(polls(spark, (0, 10 * MIN), (20 * MIN, 30 * MIN))).first()
    assert (c["covered_min"], c["period_min"]) == (20.0, 30.0)
    assert tuple(B.default_period(df).first()) == (0, 1440 * MIN)
    assert B.islands(df.limit(0)).count() == 0 and B.coverage(df.limit(0)).first()["covered_min"] == 0


def test_failed_polls_cover_nothing(spark):
    rows = [(0, "s", 0, 10 * MIN, True), (1, "s", 10 * MIN, 50 * MIN, False), (2, "s", 50 * MIN, 60 * MIN, True), (3, "s", 60 * MIN, 90 * MIN, None), (4, "t", 55 * MIN, 58 * MIN, True)]
    df = spark.createDataFrame(rows, "pos int, stream string, from_ms long, to_ms long, ok boolean")
    assert sorted(tuple(r) for r in B.islands(df).collect()) == [(0, 10 * MIN), (50 * MIN, 60 * MIN)]
    assert tuple(B.coverage(df).first()) == (20.0, 60.0)
    assert tuple(B.default_period(df.where("pos > 0")).first()) == (50 * MIN, 1490 * MIN)
    assert [tuple(r) for r in B.missed_polls(df, 15 * MIN).collect()] == [("s", 10 * MIN, 50 * MIN)]
    assert B.islands(df.where("not ok")).count() == 0 and B.default_period(df.where("pos = 1")).first()["from_ms"] is None


def test_islands_of_one_stream_spread_over_tasks(spark):
    """A million windows that are apart, and as many that are one stretch across all parts."""
    n = 1_000_000
    apart = spark.range(n).select((F.col("id") * 10).alias("from_ms"), (F.col("id") * 10 + 9).alias("to_ms"))
    dealt, part = dealt_in_order(apart, [], [F.col("from_ms")])
    sizes = [r["count"] for r in dealt.groupBy(part).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < n / 2
    got = B.islands(apart)
    assert got.count() == n and got.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == 9 * n
    one = apart.withColumn("to_ms", F.when(F.col("from_ms") == 0, 10 * n).otherwise(F.col("to_ms")))
    assert [tuple(r) for r in B.islands(one.limit(n)).collect()] == [(0, 10 * n)]


def test_running_max_takes_over_from_the_parts_before(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), k, r.randrange(1000) if r.random() < 0.8 else None) for k in range(3000)]
    dealt, part = dealt_in_order(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], [F.col("k")])
    got = {x["k"]: x["m"] for x in running_max(dealt, part, ["g"], [F.col("k")], "v", "m").collect()}
    top, want = {}, {}
    for g, k, v in rows:
        want[k] = top.get(g)
        top[g] = max((x for x in (top.get(g), v) if x is not None), default=None)
    assert got == want


@pytest.mark.parametrize("ranges", [7, 4096])
def test_medians_by_counting(spark, monkeypatch, ranges):
    monkeypatch.setattr(ranking, "RANGES", ranges)
    r = random.Random(2)
    rows = [("odd", r.randrange(-50, 10**12)) for _ in range(301)] + [("even", r.randrange(40)) for _ in range(200)] + [("one", 7), ("none", None), (None, 3), (None, 4), ("far", -(10**17)), ("far", 10**17)] + [("same", 5)] * 50
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for y, x in rows if y == g and x is not None)
        if v:
            want[g] = (v[(len(v) - 1) // 2], v[len(v) // 2])
    out = medians(spark.createDataFrame(rows, "g string, v long"), "g", "v")
    assert {x["g"]: (x["lower"], x["upper"]) for x in out.collect()} == want
    assert medians(spark.createDataFrame([], "g string, v long"), "g", "v").count() == 0


def test_take_new(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "c")], "pos int, key string")
    assert sorted(r["pos"] for r in B.take_new(rows).collect()) == [1, 3, 4, 5, 6]
    assert sorted(r["pos"] for r in B.take_new(rows, rows.where("pos = 3")).collect()) == [1, 4, 5, 6]


@pytest.mark.parametrize(("total", "want"), [(600, "OK"), (601, "OVER-60"), (1000, "OVER-60"), (1001, "OVER-100"), (0, "OK")])
def test_meter_status_is_exact(spark, total, want):
    df = spark.createDataFrame([(float(total), 43200.0, 1000.0)], "t double, c double, a double")
    assert df.select(B.meter_status(F.col("t"), F.col("c"), F.col("a"))).first()[0] == want


ROW = "p string, ok int, ms long, cpuMs long, n long, bytes long, rcW long, rcR long"


def test_stats_and_reads(spark):
    rows = spark.createDataFrame([("edition", 1, 1, 10, 1, 100, 1, 0), ("edition", 1, 1, 20, 1, 20_001, 1, 0), ("edition", 0, 1, 5, 1, 9, 2, 0), ("kev", 1, 1, 1, 1, 9000, 1, 0), ("render", 1, 1, 1, 1, 0, 0, 7), ("render", 1, 1, 1, 1, 0, 0, 1)], ROW)
    s = {r["p"]: r for r in B.producer_stats(rows).collect()}
    assert list(s) == C.PRODUCERS or sorted(s) == sorted(C.PRODUCERS)
    assert (s["edition"]["median_bytes"], s["edition"]["units"], s["edition"]["fail"], s["ssvc"]["lines"]) == (10_051, 1 + 3 + 2, 1, 0)
    req = spark.createDataFrame([("/feed.xml", "stale"), ("/feed/all.json", "MISS"), ("/feeds", "MISS"), ("/feed.json", "HIT")], "path string, cache string")
    assert tuple(B.read_units(rows, req).first()) == (2 * (2 + 2) + 5 + 2 * 2, True)
    assert tuple(B.read_units(rows.where("p = 'kev'"), req).first()) == (0, False)
    day = polls(spark, (0, 1440 * MIN))
    out = B.report(rows, req, day, {"writes": 100, "reads": 10_000, "cpu_s": 1})
    assert out[0] == "coverage: 1440/1440 min (100.0%)" and any("OVER-100" in x for x in out) and out[-1].startswith("- epss")
    assert B.report(rows, req, polls(spark, (0, MIN)), {"writes": 1, "reads": 1, "cpu_s": 1}) == ["INSUFFICIENT_COVERAGE"]


def test_capture_writes_rows_once(spark):
    rows = spark.range(20).select(F.timestamp_seconds(1_700_000_000 + F.col("id") % 10).alias("at"), (F.col("id") % 10).cast("string").alias("key"))
    assert R.run_capture(spark, rows).count() == 10


def test_refresh_keeps_the_last_good_edition(spark):
    """Each edition is of all items so far; a rejected one leaves the last, and other errors aren't taken for a rejection."""
    from pyspark.errors import StreamingQueryException

    from tidewire.operators.edition import Rejected

    source, versions, check = (new_path(spark, n) for n in "abc")

    def compose(batch):
        if batch.where("x = 3").count() and not batch.where("x = 4").count():
            raise Rejected("not admitted")
        if batch.where("x = 5").count():
            raise ValueError("a fault")
        return batch.agg(F.sum("x").alias("s"))

    want = {1: 1, 2: 3, 3: 3, 4: 10}
    for value in (1, 2, 3, 4):
        spark.createDataFrame([(value,)], "x int").coalesce(1).write.mode("append").parquet(source)
        R.refresh(spark.readStream.schema("x int").parquet(source), compose, versions, check).awaitTermination()
        assert R.current(spark, versions).first()["s"] == want[value]
    spark.createDataFrame([(5,)], "x int").coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(StreamingQueryException):
        R.refresh(spark.readStream.schema("x int").parquet(source), compose, versions, check).awaitTermination()
    assert R.current(spark, versions).first()["s"] == 10


def test_refresh_keeps_a_horizon_of_batches(spark):
    source, versions, check = (new_path(spark, n) for n in "abc")
    for value in (1, 2, 4):
        spark.createDataFrame([(value,)], "x int").coalesce(1).write.mode("append").parquet(source)
        R.refresh(spark.readStream.schema("x int").parquet(source), lambda b: b.agg(F.sum("x").alias("s")), versions, check, keep=2).awaitTermination()
    assert R.current(spark, versions).first()["s"] == 6


def test_refresh_deletes_what_is_older_than_its_horizon(spark, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(R, "EDITIONS", 2)
    source, versions, check = (new_path(spark, n) for n in "abc")
    for value in (1, 2, 4, 8):
        spark.createDataFrame([(value,)], "x int").coalesce(1).write.mode("append").parquet(source)
        R.refresh(spark.readStream.schema("x int").parquet(source), lambda b: b.agg(F.sum("x").alias("s")), versions, check, keep=2).awaitTermination()
    there = Path(versions.removeprefix("file://"))
    assert sorted(p.name for p in (there / "items").iterdir()) == ["batch=2", "batch=3"]
    assert len(list(there.glob("v0*"))) == 2 and R.current(spark, versions).first()["s"] == 12


def test_sinks(spark):
    kind = "slug string, feed_title string, feed_rank int, title string, url string, summary string, source string, tier string, source_type string, section string, importance string, importance_reason string, cves array<string>, published_ms long"
    items = spark.createDataFrame([("all", "All", 2, "b", "https://e/2", "", "Other", "T", "news", "S", "normal", None, [], 0), ("all", "All", 1, "a <b>", "https://e/1", "s\x07", "Known", "T", "news", "S", "high", "Breach", ["CVE-2024-1111"], 0)], kind)
    src = spark.createDataFrame([("Known", "https://k?a&b")], "name string, url string")
    body = K.rss(items, src, 0, "https://x", "Name", "About").first()["body"]
    from xml.etree import ElementTree

    tree = ElementTree.fromstring(body)
    got = tree.findall("channel/item")
    assert [x.find("title").text for x in got] == ["a <b>", "b"] and got[0].find("source").get("url") == "https://k?a&b" and got[1].find("source") is None and got[1].find("description") is None
    feed = json.loads(K.json_feed(items, 0, "https://x", "Name", "About").first()["body"])
    assert [x["content_text"] for x in feed["items"]] == ["s\x07", "b"] and feed["items"][1]["_tidewire"]["importance_reason"] is None and "summary" not in feed["items"][1]
    assert feed["items"][0]["tags"] == ["S", "high", "CVE-2024-1111"]
    K.write_feeds(K.rss(items, src, 0, "https://x", "Name", "About"), path := new_path(spark, "feeds"))
    assert spark.read.text(path).count() > 10


def test_scratch_is_deleted(spark):
    from pathlib import Path

    from tidewire.operators.graph import components
    from tidewire.plans import store

    with store.scratch(spark):
        kept = store.save(spark.range(5), "kept")
        rows = components(spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long")).count()
        mine = [Path(x.removeprefix("file://")) for x in store._WRITTEN]
        assert rows == 51 and kept.count() == 5 and sum(x.name.startswith("links") for x in mine if x.exists() and x in mine[-2:]) == 1
    assert not any(x.exists() for x in mine[-2:])


def test_a_cluster_needs_a_shared_folder(spark):
    from tidewire.plans import store

    class Conf:
        def __init__(self, **have):
            self.have = have

        def get(self, key, default=None):
            return self.have.get(key, default)

    class Session:
        conf = Conf(**{"spark.master": "spark://h:7077"})

    with pytest.raises(ValueError):
        store.shared_dir(Session())
    Session.conf = Conf(**{"spark.master": "spark://h:7077", "spark.checkpoint.dir": "hdfs:///x"})
    assert store.shared_dir(Session()) == "hdfs:///x"


def test_fresh_names(spark):
    assert fresh(spark.createDataFrame([(1, 2)], "a int, _A int"), "a", "b", "a") == ["__a", "b", "___a"]
