"""What is kept from batch to batch."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import edition as E
from tidewire.plans import keyed as K
from tidewire.plans.store import new_path
from tidewire.streaming import stories as S

ARTICLE = "idx long, url string, title string, published_ms long, tier string"


def test_a_look_up_reads_the_buckets_that_may_hold_a_key(spark):
    path = new_path(spark, "keyed")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("key"), F.col("id").alias("root"))
    ask = lambda a, b: rows(a, b).select("key")
    assert K.touched(ask(0, 9), path, 5) == [] and K.held(ask(0, 9), path, 5, "key string, root long").count() == 0
    K.append(rows(0, 3000), path, 0)
    K.append(rows(3000, 3100), path, 1)
    K.append(rows(3000, 3100), path, 1)  # again: replaces itself
    assert sorted(r["root"] for r in K.held(ask(2990, 3010), path, 2, "key string, root long").collect()) == list(range(2990, 3010))
    assert K.held(ask(3000, 3010), path, 1, "key string, root long").count() == 0  # a batch doesn't see itself
    assert len(K.touched(ask(7, 8), path, 2)) <= 2 and K.touched(ask(0, 0), path, 2) == []
    assert len(K.touched(ask(10_000, 10_100), path, 2)) < 20  # of 64 and 64 folders
    held = K.held(ask(5, 8), path, 2, "key string, root long")
    assert {tuple(f.rsplit("/", 3)[1:3]) for f in held.inputFiles()} == {(f"batch={b}", f"bucket={k}") for b, k in K.touched(ask(5, 8), path, 2)}
    assert K.every(spark, path, 2, "key string, root long").count() == 3100


def test_filters_have_no_false_negative_and_few_false_positives():
    import numpy as np

    r = np.random.default_rng(1)
    h, g = (r.integers(-(1 << 63), 1 << 63, 20_000) for _ in range(2))
    said = K._filter(h[:10_000], g[:10_000])
    hit = [K._may_hold(said, h[k : k + 1], g[k : k + 1]) for k in range(20_000)]
    assert all(hit[:10_000]) and sum(hit[10_000:]) < 150


def articles(seed, n=240):
    """Articles that share URLs and titles in chains over any number of batches."""
    r = random.Random(seed)
    return [(k, f"https://e.org/{r.randrange(n)}" if r.random() < 0.9 else "https://e.org/?", f"title {r.randrange(n)}" if r.random() < 0.8 else "", r.choice([None, *range(50)]), r.choice(["Government", "Executive News", "Tech & General"])) for k in range(n)]


def survivors(spark, rows, batches, state):
    for number, batch in enumerate(batches):
        S.extend(spark.createDataFrame(batch, ARTICLE), state, number, buckets=4)
    return sorted(r["idx"] for r in S.survivors(spark.createDataFrame(rows, ARTICLE), state).collect())


def test_stories_in_batches_are_those_of_all_at_once(spark, seed=1):
    rows = articles(seed)
    want = sorted(r["idx"] for r in E.dedupe(spark.createDataFrame(rows, ARTICLE)).collect())
    order = random.Random(seed).sample(rows, len(rows))
    batches = [order[k::4] for k in range(3)] + [order[3::4] + order[:20]]  # some articles come again
    assert survivors(spark, rows, batches, new_path(spark, "stories")) == want


def test_a_batch_that_failed_half_way_is_taken_again(spark, monkeypatch):
    rows = articles(3, 90)
    want = sorted(r["idx"] for r in E.dedupe(spark.createDataFrame(rows, ARTICLE)).collect())
    state, real, calls = new_path(spark, "stories"), K.append, []

    def once(*a, **k):
        calls.append(1)
        if len(calls) == 4:  # of the second batch the keys are written, the roots not
            raise OSError("gone")
        real(*a, **k)

    monkeypatch.setattr(K, "append", once)
    S.extend(spark.createDataFrame(rows[:40], ARTICLE), state, 0, buckets=4)
    with pytest.raises(OSError):
        S.extend(spark.createDataFrame(rows[40:60], ARTICLE), state, 1, buckets=4)
    for number, batch in ((1, rows[40:60]), (2, rows[60:])):
        S.extend(spark.createDataFrame(batch, ARTICLE), state, number, buckets=4)
    assert sorted(r["idx"] for r in S.survivors(spark.createDataFrame(rows, ARTICLE), state).collect()) == want


def test_the_last_batch_reads_no_old_article(spark, monkeypatch):
    """The stream's old batches are gone before the last one comes; of the state it reads the folders that may hold its keys."""
    rows = [(k, f"https://e.org/{k}", f"own title {k}", k, "Government") for k in range(200)] + [(999, "https://e.org/17", "other", 0, "Government")]
    source, state, out, check = (new_path(spark, n) for n in "abcd")
    import shutil

    for number in range(4):
        if number == 3:
            for k in range(3):
                shutil.rmtree(f"{out}/batch={k}".removeprefix("file://"))
        batch = rows[number:200:3] if number < 3 else rows[200:]
        spark.createDataFrame(batch, ARTICLE).coalesce(1).write.mode("append").parquet(source)
        S.follow(spark.readStream.schema(ARTICLE).parquet(source), state, out, check, buckets=16).awaitTermination()
    assert [r["idx"] for r in S.lost(spark, state).collect()] == [17] and S.lost(spark, state, 2).count() == 0
    asked = spark.createDataFrame([(999,)], "idx long").selectExpr("md5(cast('uhttps://e.org/17' as binary)) as key")
    assert len(K.touched(asked, f"{state}/keys", 3, "key", 16)) <= 2  # of 48 folders
    assert not {"url", "title"} & {c for t in ("keys", "roots") for c in spark.read.parquet(f"{state}/{t}/rows").columns}


def test_links_of_a_batch_beyond_those_of_the_plain_bound_are_settled_by_one_task(spark, monkeypatch):
    """No rounds for a batch of a few links more than ONE_TASK of the graph; with less allowed there are some, and the result is the same."""
    from tidewire.operators import graph

    rows = articles(4, 90)
    want = sorted(r["idx"] for r in E.dedupe(spark.createDataFrame(rows, ARTICLE)).collect())
    rounds, real = [], graph._stars
    monkeypatch.setattr(graph, "ONE_TASK", 3)
    monkeypatch.setattr(graph, "_stars", lambda e: rounds.append(1) or real(e))
    for bound, some in ((1 << 18, False), (3, True)):
        monkeypatch.setattr(S, "ONE_TASK", bound, raising=False)
        rounds.clear()
        assert survivors(spark, rows, [rows[:60], rows[60:]], new_path(spark, "stories")) == want
        assert bool(rounds) == some
