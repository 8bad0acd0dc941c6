"""Stories that grow batch by batch: which articles tell the same one, kept so that a batch looks at no article of another.

State is two keyed tables and a list. `keys` names a story by each URL or title key that an article of it has had. `roots` has of each
story its size and its best article's order, and of one that has been merged into another that one's name; the larger story keeps its
name, so a name is at most log2(n) steps from the present one. `lost` lists articles that another of their story has beaten; stories only grow,
so an article that has lost never returns.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.edition import tier_weight, with_keys
from tidewire.operators.graph import components
from tidewire.plans import keyed as K
from tidewire.plans.store import exists, save, scratch

#: Links of a batch that one task settles, at most (about 100 MB there); more of them take rounds over all tasks, with the same result.
ONE_TASK = 1 << 18

_BEST = "struct<t:long,w:double,i:long>"
_KEYS, _ROOTS = "key string, root long", f"root long, now long, size long, best {_BEST}"


def _resolved(names: DataFrame, state: str, number: int, buckets: int) -> DataFrame:
    """(was, root, size, best) of names (root) of stories: what each is called now. One look-up for each step that some name is behind."""
    spark = names.sparkSession
    done, ask = None, names.select(F.col("root").alias("was"), "root")
    while not ask.isEmpty():
        rows = K.held(ask.select("root").distinct(), f"{state}/roots", number, _ROOTS, "root", buckets)
        last = rows.groupBy("root").agg(F.max_by(F.struct("now", "size", "best"), "batch").alias("s")).select("root", "s.*")
        found = save(ask.join(last, "root"), "found")
        here = found.where("now is null").select("was", "root", "size", "best")
        done = here if done is None else done.unionByName(here)
        ask = found.where("now is not null").select("was", F.col("now").alias("root"))
    return spark.createDataFrame([], f"was long, root long, size long, best {_BEST}") if done is None else done


def _together(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Run writes that don't read one another at the same time; the first error is raised once all have ended."""
    with ThreadPoolExecutor(len(writes)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]
    for one in started:
        one.result()


def extend(articles: DataFrame, state: str, number: int, buckets: int = K.BUCKETS) -> None:
    """Take batch `number` of articles (idx, url, title, published_ms, tier) into the state; one that comes again replaces itself.

    Reads the batch, and of the state the buckets that may hold one of its keys. A batch may bring an article again; an article
    with neither key is in no story. Null titles and URLs have no key.
    """
    spark = articles.sparkSession
    with scratch(spark):
        order = F.struct(F.coalesce("published_ms", F.lit((1 << 63) - 1)).alias("t"), (-tier_weight()).alias("w"), F.col("idx").alias("i"))
        both = F.array(F.concat(F.lit("u"), "url_key"), F.when(F.col("title_key") != "", F.concat(F.lit("t"), "title_key")))
        own = save(with_keys(articles).select("idx", order.alias("best"), F.explode(both).alias("key")).where("key is not null").withColumn("key", F.md5(F.col("key").cast("binary"))), "own")
        hits = save(K.held(own.select("key").distinct(), f"{state}/keys", number, _KEYS, "key", buckets).select("key", "root"), "hits")
        now = _resolved(hits.select("root").distinct(), state, number, buckets)

        first = own.groupBy("key").agg(F.min("idx").alias("b"))
        edges = own.join(first, "key").select(F.col("idx").alias("a"), "b")
        edges = edges.unionByName(hits.join(now.select(F.col("was").alias("root"), F.col("root").alias("a")), "root").join(first, "key").select("a", "b"))
        parts = components(edges.where("a <> b"), one_task=ONE_TASK)
        new = own.groupBy("idx").agg(F.min("best").alias("best")).select(F.col("idx").alias("v"), F.lit(1).cast("long").alias("size"), "best", F.lit(False).alias("old"))
        old = now.select(F.col("root").alias("v"), "size", "best", F.lit(True).alias("old")).distinct()
        members = new.unionByName(old).join(parts.select("v", F.col("root").alias("part")), "v", "left").withColumn("part", F.coalesce("part", "v"))
        stories = members.groupBy("part").agg(F.sum("size").alias("all_size"), F.min("best").alias("top"), F.min(F.struct(~F.col("old"), -F.col("size"), F.col("v").alias("v"))).alias("name"))
        members = save(members.join(stories.select("part", "all_size", "top", F.col("name.v").alias("name")), "part"), "members")

        fresh = own.join(hits, "key", "left_anti").join(members.where("not old").select(F.col("v").alias("idx"), "name"), "idx")
        none = F.lit(None)
        kept = members.select(F.col("name").alias("root"), none.cast("long").alias("now"), F.col("all_size").alias("size"), F.col("top").alias("best")).distinct()
        merged = members.where("old and v <> name").select(F.col("v").alias("root"), F.col("name").alias("now"), "size", none.cast(_BEST).alias("best"))
        beaten = members.where("best.i <> top.i").select(F.col("best.i").alias("idx")).distinct()
        _together(
            spark,
            lambda: K.append(fresh.select("key", F.col("name").alias("root")).distinct(), f"{state}/keys", number, "key", buckets),
            lambda: K.append(kept.unionByName(merged), f"{state}/roots", number, "root", buckets),
            lambda: beaten.write.mode("overwrite").parquet(f"{state}/lost/batch={number}"),
        )


def lost(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame:
    """(idx) of the articles that another one of their story has beaten by batch `upto`, or by the last."""
    if not exists(spark, f"{state}/lost"):
        return spark.createDataFrame([], "idx long")
    rows = spark.read.schema("idx long, batch int").parquet(f"{state}/lost")
    return (rows if upto is None else rows.where(F.col("batch") <= upto)).select("idx").distinct()


def follow(articles: DataFrame, state: str, out: str, checkpoint: str, every: int | None = None, buckets: int = K.BUCKETS) -> StreamingQuery:
    """Keep stories of a stream of articles: each batch is written to `out` and taken into the state, each as often as it takes, with the same result."""

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        extend(batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/batch={number}"), state, number, buckets)

    trigger = {"availableNow": True} if every is None else {"processingTime": f"{every} seconds"}
    return articles.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def survivors(articles: DataFrame, state: str) -> DataFrame:
    """Of all articles so far the best one of each story."""
    return articles.join(lost(articles.sparkSession, state), "idx", "left_anti")
