"""Tables of keys that grow batch by batch.

Rows are dealt by a hash of their key into buckets, one folder for each bucket of each batch, with a Bloom filter beside it. A
look-up tests its keys against the filters of their buckets first, and reads only the folders that may hold one of them. A batch
that is written again replaces itself, and a reader of batch n sees those before n only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.store import exists, tasks

#: Buckets of a table by default; a bucket of a batch is to fit in a task's memory as hashes.
BUCKETS = 64
#: Bits of a filter for each key, and bits that a key sets: about one look-up in 300 is for nothing.
BITS, SET = 12, 6


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit("bucket")), F.lit(buckets)).cast("int")


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(F.col(key)).alias("h"), F.xxhash64(F.lit("step"), F.col(key)).alias("g")]


def _places(h: np.ndarray, g: np.ndarray, bits: int) -> np.ndarray:
    """The bits (rows x SET) of keys in a filter of `bits` bits, a power of two."""
    step = np.arange(SET, dtype=np.uint64)[None, :]
    return (h.view(np.uint64)[:, None] + step * (g.view(np.uint64)[:, None] | np.uint64(1))) & np.uint64(bits - 1)


def _filter(h: np.ndarray, g: np.ndarray) -> bytes:
    bits = 1 << max(6, math.ceil(math.log2(len(h) * BITS)))
    on = np.zeros(bits, bool)
    on[_places(h, g, bits).ravel()] = True
    return np.packbits(on).tobytes()


def _may_hold(said: bytes, h: np.ndarray, g: np.ndarray) -> bool:
    on = np.frombuffer(said, np.uint8)
    at = _places(h, g, len(on) * 8)
    return bool(((on[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1).any())


def append(rows: DataFrame, path: str, number: int, key: str = "key", buckets: int = BUCKETS) -> None:
    """Write `rows` as batch `number` of the table at `path`, with their filters."""
    dealt = rows.withColumn("bucket", _bucket(key, buckets))
    dealt.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hs, gs = None, [], []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_filter(np.concatenate(hs), np.concatenate(gs))], pa.binary())], names=["bucket", "bits"])

        for rb in batches:
            bucket, h, g = (rb.column(k).to_numpy() for k in range(3))
            for b in np.unique(bucket).tolist():
                if b != now and hs:
                    yield made()
                    hs, gs = [], []
                now = b
                hs.append(h[bucket == b])
                gs.append(g[bucket == b])
        if hs:
            yield made()

    written = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows/batch={number}")
    keyed = written.select("bucket", *_hashes(key)).repartition("bucket").sortWithinPartitions("bucket")
    keyed.mapInArrow(filters, "bucket int, bits binary").write.mode("overwrite").parquet(f"{path}/filters/batch={number}")


def touched(keys: DataFrame, path: str, before: int, key: str = "key", buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """(batch, bucket) of the folders that may hold one of `keys`: at most as many as the batches before `before` times `buckets`."""
    spark = keys.sparkSession
    if not exists(spark, f"{path}/filters"):
        return []
    held = spark.read.schema("bucket int, bits binary, batch int").parquet(f"{path}/filters").where(F.col("batch") < before)
    asked = keys.select(_bucket(key, buckets).alias("bucket"), *_hashes(key), F.lit(None).cast("int").alias("batch"), F.lit(None).cast("binary").alias("bits"))
    none = F.lit(None).cast("long")
    both = asked.unionByName(held.select("bucket", none.alias("h"), none.alias("g"), "batch", "bits"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filters = None, {}
        for rb in batches:
            bucket, (h, g) = rb.column(0).to_numpy(), (rb.column(k).fill_null(0).to_numpy() for k in (1, 2))
            is_key = np.asarray(rb.column(3).is_null())
            for b in np.unique(bucket).tolist():
                if b != now:
                    now, filters = b, {}
                mine = bucket == b
                for k in np.flatnonzero(mine & ~is_key).tolist():  # filters come before the keys of their bucket
                    filters[rb.column(3)[k].as_py()] = rb.column(4)[k].as_py()
                mine &= is_key
                hit = [batch for batch, said in filters.items() if mine.any() and _may_hold(said, h[mine], g[mine])]
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array([b] * len(hit), pa.int32())], names=["batch", "bucket"])

    rows = both.repartition(tasks(spark), "bucket").sortWithinPartitions("bucket", F.asc_nulls_last("batch")).mapInArrow(test, "batch int, bucket int")
    return sorted((r["batch"], r["bucket"]) for r in rows.distinct().collect())


def held(keys: DataFrame, path: str, before: int, schema: str, key: str = "key", buckets: int = BUCKETS) -> DataFrame:
    """Rows (`schema` and the number of their batch) of the batches before `before` whose key is one of `keys`, which are distinct."""
    spark = keys.sparkSession
    folders = [f"{path}/rows/batch={batch}/bucket={bucket}" for batch, bucket in touched(keys, path, before, key, buckets)]
    whole = f"{schema}, batch int"
    if not folders:
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(f"{schema}, batch int, bucket int").option("basePath", f"{path}/rows").parquet(*folders).drop("bucket")
    return rows.join(keys.select(key), key, "left_semi").select(*spark.createDataFrame([], whole).columns)


def every(spark: SparkSession, path: str, before: int, schema: str) -> DataFrame:
    """All rows of the batches before `before`."""
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/rows").where(F.col("batch") < before)
