"""Importance resampling towards a target distribution over hashed n-grams.

The bucket of an n-gram is a CRC of its bytes. A CRC is linear over GF(2): that of two strings one after the other is the first one's, shifted
by the length of the second by a 32 x 32 matrix, plus the second one's. So each word's CRC is computed once, in step with those of
all other words of a batch, and those of n-grams are composed from them; no n-gram is ever a string.

Two passes over the texts: one counts buckets in each task and sums them, the other weighs each document by the buckets' gains, of which there are
as many as buckets, whatever the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import _text as X
from tidewire.operators.ranking import ranked_within
from tidewire.plans.store import fresh, save

#: Words of a feature at most, and buckets.
ORDERS, BUCKETS = 1, 10_000
#: Of 100 documents with so many words at least so many are drawn; what is hashed before an id.
SHARE, LEAST_WORDS, SEED = 10, 20, "2024"
#: Words of up to so many bytes are read in step; longer ones one by one.
IN_STEP = 48

_POLY = 0xEDB88320


@cache
def _byte_table() -> np.ndarray:
    """What a byte adds to the register, by the rule of the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(_POLY), t >> np.uint32(1))
    return t


def _times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, given by its 32 columns, times each vector of 32 bits."""
    out = np.zeros(v.shape, np.uint32)
    for k in range(32):
        out ^= np.where((v >> np.uint32(k)) & np.uint32(1), matrix[k], np.uint32(0))
    return out


@cache
def _shift_tables(power: int) -> np.ndarray:
    """The shift by 2^power bytes as four tables of 256: what each byte of a register becomes."""
    if power == 0:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        matrix = _byte_table()[columns & np.uint32(255)] ^ (columns >> np.uint32(8))
    else:
        half = _columns(power - 1)
        matrix = _times(half, half)
    each = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, each << np.uint32(8 * k)) for k in range(4)])


def _columns(power: int) -> np.ndarray:
    tables = _shift_tables(power)
    return np.array([tables[k // 8][1 << (k % 8)] for k in range(32)], np.uint32)


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs shifted by lengths in bytes: what they add to that of a string that so many bytes follow."""
    out = crc.astype(np.uint32)
    for power in range(int(by.max()).bit_length() if len(by) else 0):
        at = np.flatnonzero((by >> power) & 1)
        t, v = _shift_tables(power), out[at]
        out[at] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
    return out


def word_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC32 of each byte span."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -IN_STEP, "left"))
    out = np.empty(len(size), np.uint32)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    order = order[long:]
    if len(order):
        reg, at, table = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order], _byte_table()
        live = np.searchsorted(-size[order], -np.arange(int(size[order[0]])), "left")
        for k, m in enumerate(live.tolist()):
            r = reg[:m]
            reg[:m] = table[(r ^ buf[at[:m] + k]) & 255] ^ (r >> np.uint32(8))
        out[order] = ~reg
    return out


def feature_crcs(buf: np.ndarray, off: np.ndarray, orders: int = ORDERS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each number of words from 1 on the CRCs of the features that begin at each word and the text of each feature."""
    low = X.LOWER[buf]
    starts, ends, at = X.words(low, off, X.ALNUM)
    text = np.repeat(np.arange(len(off) - 1), np.diff(at))
    crc, size = word_crcs(low, starts, ends), ends - starts
    out, now = [(crc, text)], crc
    if orders > 1:
        spaced = shifted(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc
    for g in range(2, orders + 1):
        now = shifted(now[:-1], size[g - 1 :] + 1) ^ spaced[g - 1 :] if len(now) else now
        whole = text[: len(now)] == text[g - 1 :] if len(now) else np.zeros(0, bool)
        out.append((now[whole], text[: len(now)][whole]))
    return np.diff(at), out


def bucket_counts(df: DataFrame, text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts: a task sends one row for each bucket that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rb in batches:
            for _, _, buf, off in X.pieces(rb, "t"):
                for crc, _ in feature_crcs(buf, off, orders)[1]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], names=["bucket", "n"])

    return df.select(F.col(text).alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: thousandths of the log ratio of its smoothed shares of target and documents, rounded down."""
    spark = docs.sparkSession
    both = bucket_counts(docs, text, orders, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, text, orders, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    summed = save(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = summed.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s_all"), F.coalesce(F.sum("t"), F.lit(0)).alias("t_all")).first()
    d = lambda c: F.col(c).cast("double") if isinstance(c, str) else F.lit(float(c))
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(summed, "bucket", "left").fillna(0)
    gain = F.floor(F.lit(1000.0) * F.log((d("t") + 1) * d(total["s_all"] + buckets) / ((d("s") + 1) * d(total["t_all"] + buckets))))
    out = np.zeros(buckets, np.int64)
    for r in every.select("bucket", gain.alias("g")).collect():  # a row for each bucket, a parameter
        out[r["bucket"]] = r["g"]
    return out


def noise(key: Column, seed: str = SEED) -> Column:
    """Gumbel noise of an id in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", orders: int = ORDERS, seed: str = SEED, keep_text: bool = True) -> DataFrame:
    """Every row of `docs` with n_words, n_features, weight (the mean gain of its features, rounded down; 0 of none) and score.

    A null, empty or wordless text has no feature. A null key counts as the empty text. Columns named like an added one are replaced,
    but the key and the text may not be.
    """
    names = ["n_words", "n_features", "weight", "score"]
    if clash := {key, text} & set(names):
        raise ValueError(f"rename {sorted(clash)}: the operator adds columns of these names")
    own = docs.drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(gain)
    shown = [f for f in own.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*shown, *(T.StructField(c, T.LongType()) for c in names[:3])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value
        for rb in batches:
            for i, j, buf, off in X.pieces(rb, text):
                n_words, features = feature_crcs(buf, off, orders)
                n, total = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for crc, at in features:
                    n += np.bincount(at, minlength=j - i)
                    before = np.concatenate([[0], np.cumsum(g[crc % np.uint32(len(g))])])
                    edge = np.searchsorted(at, np.arange(j - i + 1))
                    total += before[edge[1:]] - before[edge[:-1]]
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([*(rb.column(f.name).slice(i, j - i) for f in shown), pa.array(n_words), pa.array(n), pa.array(weight)], names=schema.names)

    return own.mapInArrow(run, schema).withColumn("score", (F.col("weight") + noise(F.col(key), seed)).cast("long"))


def ranked(rows: DataFrame, key: str = "doc_id", share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """Rows (key, n_words, score, ...) with rank: of the N rows of `least` words or more the floor(share * N / 100) of the highest scores, from 1.

    Ties go to the smaller key, null keys after all others; of equal rows each has a rank of its own. All other rows have none.
    """
    held = save(rows, "scores")  # dealing by range looks at its rows twice
    may = held.where(F.col("n_words") >= least)
    drawn = share * may.count() // 100
    (all_,) = fresh(held, "all_rows")
    place = ranked_within(may.withColumn(all_, F.lit(0)), all_, [F.desc("score"), F.asc_nulls_last(key)], "rank").drop(all_)
    place = place.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return place.unionByName(held.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, share: int = SHARE, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """The drawn rows of `docs` whole, with n_words, n_features, weight, score and rank. Only texts of the drawn rows, and of rows that tie with the last, are dealt out."""
    gain = gains(docs, target, text, orders, buckets)
    narrow = scored(docs.select(key, text), gain, key, text, orders, seed, keep_text=False)
    last = ranked(narrow, key, share, least).where("rank is not null").select("score", F.col(key).alias("k"), "rank").orderBy(F.desc("rank")).first()
    whole = scored(docs.drop("rank") if "rank" not in (key, text) else docs, gain, key, text, orders, seed).where(F.col("n_words") >= least)
    if last is None:
        return whole.where(F.lit(False)).withColumn("rank", F.lit(None).cast("long"))
    before = F.lit(True) if last["k"] is None else F.coalesce(F.col(key) <= F.lit(last["k"]), F.lit(False))
    tops = save(whole.where((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & before)), "drawn")
    (all_,) = fresh(tops, "all_rows")
    order = [F.desc("score"), F.asc_nulls_last(key), F.xxhash64(*tops.columns)]
    return ranked_within(tops.withColumn(all_, F.lit(0)), all_, order, "rank").drop(all_).where(F.col("rank") <= last["rank"])


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gain = gains(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return ranked(scored(docs, gain, keep_text=False)).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH tb AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLY}) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)),
k AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(x) // 2), lambda p: ('0x' || substr(x, 2 * p + 1, 2))::BIGINT)), lambda c, y: xor(c >> 8, tab[1 + (xor(c, y) & 255)])), 4294967295) % {BUCKETS} AS bucket FROM v, tb),
s AS (SELECT bucket, count(*) AS s FROM d JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + {BUCKETS}) / ((s::DOUBLE + 1) * (t_all + {BUCKETS})))) AS gain FROM s LEFT JOIN t USING (bucket), n),
f AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM d JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h FROM documents),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h LEFT JOIN f USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS m FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= {SHARE} * m // 100 THEN r END AS rank FROM r
"""
