"""Streams that act on time, histories of keys, and sets published as one."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.operators import budget as B
from tidewire.plans.store import new_path
from tidewire.sources import publish as P
from tidewire.streaming import timers as T


def steps(spark, make, schema, batches):
    """Rows that a stream appends with each of several batches."""
    source, out, check = (new_path(spark, n) for n in ("in", "out", "check"))
    seen, made = set(), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        now = {tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()}
        made.append(sorted(now - seen, key=repr))
        seen = now
    return made


def test_a_gap_is_said_when_no_poll_comes_and_again_when_one_does(spark):
    batches = [
        [("s", 1000, True), ("s", 1020, True), ("s", 1010, False), ("t", 1020, None), (None, 1005, True), ("s", None, True)],
        [("t", 1100, True)],  # time goes on without s
        [("s", 1120, False), ("s", 1125, True), ("t", 1126, True)],
    ]
    made = steps(spark, lambda df: T.overdue_polls(df, 50), "stream string, to_ms long, ok boolean", batches)
    assert made[0] == [] and made[1] == [("s", 1020, 1100, "overdue")]
    assert made[2] == [("s", 1020, 1120, "missed-poll"), ("s", 1020, 1125, "missed-poll")]


def test_marks_live_as_long_as_they_may(spark):
    t, end = 1000, C.MARK_MS + 1000
    batches = [
        [(1, 1, "read", "add", t), (1, 2, "flag", "add", t + 5), (1, 2, "flag", "toggle", t + 6), (2, 1, "read", "toggle", t + 7), (2, 1, "read", "add", t + 8), (None, 1, "read", "add", t + 9), (2, 2, "read", "other", t + 9)],
        [(3, 3, "read", "add", end + 3)],  # the mark of t goes by its timer
        [(2, 1, "read", "toggle", end + 9), (1, 1, "read", "toggle", end + 10)],  # both find none, for that of t + 7 has ended too
    ]
    made = steps(spark, T.live_marks, "user_id long, article_id long, kind string, action string, at_ms long", batches)
    assert made[0] == sorted([(1, 1, "read", t, t), (1, 2, "flag", t + 5, t + 5), (1, 2, "flag", None, t + 6), (2, 1, "read", t + 7, t + 7)], key=repr)
    assert (1, 1, "read", None, end) in made[1] and (3, 3, "read", end + 3, end + 3) in made[1]
    assert {(1, 1, "read", end + 10, end + 10), (2, 1, "read", end + 9, end + 9)} <= set(made[2])
    every = spark.createDataFrame([r for m in made for r in m], "user_id long, article_id long, kind string, at_ms long, moment_ms long")
    assert sorted(tuple(r)[:2] for r in T.latest_marks(every).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_a_failing_task_leaves_the_old_set_whole(spark):
    path = new_path(spark, "feeds")
    sets = lambda names: spark.createDataFrame([(n, f"body of {n}\nsecond line") for n in names], "name string, body string").repartition(3)
    assert P.published(spark, path).count() == 0
    P.publish(sets(["a.xml", "b.json"]), path)
    fails = sets(["a.xml", "c.xml", "d.xml"]).withColumn("body", F.when(F.col("name") == "c.xml", F.raise_error(F.lit("no body"))).otherwise("new"))
    with pytest.raises(Exception, match="no body"):
        P.publish(fails, path)
    assert sorted(tuple(r) for r in P.published(spark, path).collect()) == [("a.xml", "body of a.xml\nsecond line"), ("b.json", "body of b.json\nsecond line")]
    P.publish(sets(["c.xml"]), path)
    assert len(list(Path(path.removeprefix("file://"), "versions").iterdir())) == 2  # what the failed tasks had written is gone
    assert [r["name"] for r in P.published(spark, path).collect()] == ["c.xml"]
    P.publish(sets([]), path)
    assert P.published(spark, path).count() == 0
    P.publish(sets(["d.xml"]), path, kept=2)
    assert len(list(Path(path.removeprefix("file://"), "commits").glob("0*"))) == 2


def test_new_rows_against_a_kept_history(spark):
    history, kind = new_path(spark, "history"), "pos int, key string"
    take = lambda rows, number: sorted(r["pos"] for r in B.take_new_kept(spark.createDataFrame(rows, kind), history, number, buckets=4).collect())
    assert take([(1, "a"), (2, "a"), (3, None), (4, "b")], 0) == [1, 3, 4]
    assert take([(5, "b"), (6, "c"), (7, None), (8, "c")], 1) == [6, 7]
    assert take([(5, "b"), (6, "c"), (7, None), (8, "c")], 1) == [6, 7]  # again
    assert take([(9, "c"), (10, "a")], 2) == [] and take([], 3) == []
