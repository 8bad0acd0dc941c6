"""Streaming forms: the capture's exactly-once rows, and the edition that is renewed as a whole."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidewire import config as C
from tidewire.operators.edition import Rejected
from tidewire.plans.store import new_path, remove

#: Editions that are kept, for readers who have found one.
EDITIONS = 8


def capture(rows: DataFrame, out: str, checkpoint: str, delay: str = "72 hours") -> StreamingQuery:
    """Append each row of a stream (at: timestamp, key, ...) once, however often overlapping polls bring it."""
    fresh = rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["key"])
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _trigger(seconds: int | None) -> dict:
    return {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}


def refresh(items: DataFrame, compose: Callable[[DataFrame], DataFrame], versions: str, checkpoint: str, every: int | None = None, keep: int | None = None) -> StreamingQuery:
    """Renew the edition with each batch of a stream, as a whole: composed of the items of this batch and of those before.

    Items are kept batch by batch, the newest `keep` of them: by default as many as the longest lookback spans at a refresh `every` so many
    seconds, and all without `every`, when what is there is read once. What is older is deleted, and so are editions but the last EDITIONS. An edition is written in a folder of its own and then pointed to by one more
    row of `current`, so a reader finds the last whole version at any moment, and a batch that is run again replaces nothing.
    A batch whose edition is rejected leaves the last good version in place.
    """

    if keep is None and every is not None:
        keep = math.ceil(max(C.LOOKBACK.values()) * 3600 / every) + 1

    def renew(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{versions}/items/batch={number}")
        since = 0 if keep is None else max(0, number - keep + 1)
        whole = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(f"{versions}/items").where(F.col("batch").between(since, number)).drop("batch")
        if since:  # no later batch reads it, whether this one's edition is taken or not
            remove(spark, f"{versions}/items/batch={since - 1}")
        try:
            edition = compose(whole)
        except Rejected:
            return
        name = f"v{number:09d}-{uuid.uuid4().hex}"
        edition.write.parquet(f"{versions}/{name}")
        spark.createDataFrame([(number, name)], "version long, name string").coalesce(1).write.mode("append").json(f"{versions}/current")
        for old in _editions(spark, versions).where(F.col("version") == number - EDITIONS).collect():
            remove(spark, f"{versions}/{old['name']}")

    return items.writeStream.foreachBatch(renew).option("checkpointLocation", checkpoint).trigger(**_trigger(every)).start()


def _editions(spark: SparkSession, versions: str) -> DataFrame:
    return spark.read.schema("version long, name string").json(f"{versions}/current")


def current(spark: SparkSession, versions: str) -> DataFrame:
    """The newest edition that is pointed to."""
    name = _editions(spark, versions).agg(F.max(F.struct("version", "name")).alias("m")).first()["m"]["name"]
    return spark.read.parquet(f"{versions}/{name}")


def run_capture(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """All rows of a table through the capture stream; the rows as it leaves them."""
    source, out, check = (new_path(spark, n) for n in ("capture-in", "capture-out", "capture-state"))
    rows.write.parquet(source)
    query = capture(spark.readStream.schema(rows.schema).parquet(source), out, check)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def run_refresh(spark: SparkSession, items: DataFrame, compose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table of items as one batch of the refresh stream; the edition that is then current."""
    source, versions, check = (new_path(spark, n) for n in ("items", "editions", "edition-state"))
    items.write.parquet(source)
    refresh(spark.readStream.schema(items.schema).parquet(source), compose, versions, check).awaitTermination()
    return current(spark, versions)


def windowed_counts(events: DataFrame, by: str = "event_type", size: str = "15 minutes", late: str = "72 hours") -> DataFrame:
    """(window_start, by, n) of events (ts without a zone), for streams and tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
