"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by training-token windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import _text as X
from tidewire.plans.store import fresh

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text whose windows are broadcast at once; a larger benchmark is scanned in blocks of this size. A window
#: takes 20 bytes and a word seldom less than 4 of text, so that what is broadcast stays below about 6 times this.
BLOCK_BYTES = 16 << 20
#: Bytes that a block's windows may take in memory; an item that alone takes more is an error, not a larger broadcast.
BROADCAST_BYTES = 512 << 20


#: Columns that a scan adds.
ADDED = ("n_words", "spans", "items")


def _norm(buf: np.ndarray, off: np.ndarray):
    low = X.LOWER[buf]
    starts, ends, at = X.words(low, off, X.ALNUM)
    return low, starts, ends, at, X.spans_hash(low, starts, ends)


def _one(texts) -> pa.RecordBatch:
    chunks = [c.cast(pa.large_string()) for c in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [pa.array(texts, pa.string())])]
    return pa.record_batch({"t": pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string())})


@dataclass(frozen=True)
class Windows:
    """The windows of one length, in the order of their hashes: 8 bytes of hash, 8 of place and 4 of item each, and the texts once.

    `said` holds the words of all items, single-spaced: window w is said[first[w]:end[w]], and `item[w]` is its place in `names`.
    """

    keys: np.ndarray
    first: np.ndarray
    end: np.ndarray
    item: np.ndarray
    said: np.ndarray
    names: list[str]

    @property
    def nbytes(self) -> int:
        return sum(c.nbytes for c in (self.keys, self.first, self.end, self.item, self.said))


def windows(texts: list[str | None] | pa.ChunkedArray, ids: list[str], k: int = WINDOW) -> dict[int, Windows]:
    """By length in words the windows of the items; a text of fewer than k words, but not none, is one window."""
    found: dict[int, list[tuple]] = {}
    said, base = [], 0
    for i, j, buf, off in X.pieces(_one(texts), "t", 1 << 22):
        low, starts, ends, at, h = _norm(buf, off)
        size = ends - starts
        place = np.concatenate([[0], np.cumsum(size + 1)])
        flat = np.full(place[-1], 32, np.uint8)
        inner = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        flat[np.repeat(place[:-1] - starts, size) + inner] = low[inner]
        said.append(flat)
        of = np.repeat(np.arange(j - i), np.diff(at))
        length = np.minimum(np.diff(at), k)
        for n in np.unique(length[length > 0]).tolist():
            g = X.grams(h, n)
            p = np.arange(len(g))
            p = p[(length[of[p]] == n) & (p + n <= at[of[p] + 1])]
            found.setdefault(n, []).append((g[p], base + place[p], base + place[p + n] - 1, (i + of[p]).astype(np.int32)))
        base += len(flat)
    text = np.concatenate(said) if said else np.zeros(0, np.uint8)
    small = np.int32 if base < 1 << 31 else np.int64
    out = {}
    for n, parts in found.items():
        keys, first, end, item = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        out[n] = Windows(keys[order], first[order].astype(small), end[order].astype(small), item[order], text, ids)
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, most: int) -> list[DataFrame]:
    """The benchmark in parts of a bounded size, by hash of the item; one part if it is small."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // most) if size > most else 1)
    return [benchmark.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == b) if n > 1 else benchmark for b in range(n)]


def _scan(docs: DataFrame, grams: dict, text: str, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """`docs` with n_words, spans (maximal hit runs: first word, end word, first byte, end byte) and items."""
    held = docs.sparkSession.sparkContext.broadcast(grams)
    own = docs.drop(*added)
    kinds = ("long", "array<struct<w0:long,w1:long,b0:long,b1:long>>", "array<string>")
    schema = T.StructType(own.schema.fields + T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(added, kinds, strict=True))).fields)
    names = schema.names
    span = pa.list_(pa.struct([(k, pa.int64()) for k in ("w0", "w1", "b0", "b1")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, buf, off in X.pieces(rb, text):
                low, starts, ends, at, h = _norm(buf, off)
                change = np.zeros(len(h) + 1, np.int64)
                items: dict[int, set] = {}
                for n, win in held.value.items():
                    g = X.grams(h, n)
                    if not len(g):
                        continue
                    keys = win.keys
                    where = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                    for p in np.flatnonzero(keys[where] == g).tolist():
                        doc = int(np.searchsorted(at, p, "right")) - 1
                        if p + n > at[doc + 1]:
                            continue
                        said = b" ".join(low[a:b].tobytes() for a, b in zip(starts[p : p + n], ends[p : p + n], strict=True))
                        w = int(where[p])
                        while w < len(keys) and keys[w] == g[p]:  # verified on the words themselves
                            if win.said[win.first[w] : win.end[w]].tobytes() == said:
                                change[p] += 1
                                change[p + n] -= 1
                                items.setdefault(doc, set()).add(win.names[win.item[w]])
                            w += 1
                hit = np.cumsum(change[:-1]) > 0
                spans: list[list] = [[] for _ in range(j - i)]
                for doc in items:
                    a, b = int(at[doc]), int(at[doc + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].view(np.int8), [0]))))
                    for s, e in edge.reshape(-1, 2).tolist():
                        spans[doc].append({"w0": s, "w1": e, "b0": int(starts[a + s] - off[doc]), "b1": int(ends[a + e - 1] - off[doc])})
                who = [sorted(items.get(d, ())) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([*rb.slice(i, j - i).columns, pa.array(np.diff(at).astype(np.int64)), pa.array(spans, span), pa.array(who, pa.list_(pa.string()))], names=names)

    return own.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", k: int = WINDOW, block_bytes: int = BLOCK_BYTES, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """Every row of `docs` with `n_words`, `spans` of hit words and the `items` (strings) that occur in it.

    A benchmark of over `block_bytes` is scanned in blocks, each of a bounded broadcast and a pass over the texts; what the later blocks hit is found once for
    each distinct text and joined to the rows of the first by a hash of the text, so that every row stays. Null or empty texts have no words, spans or items; null items
    and items without words have no windows. Repeated rows are scanned one by one; an empty benchmark hits nothing.
    """
    n_words, spans, items = added
    out, more = None, None
    for b, part in enumerate(_blocks(benchmark, item, item_text, block_bytes)):
        rows = part.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null").toArrow()
        grams = windows(rows.column(1), rows.column(0).to_pylist(), k)
        held = sum(w.nbytes for w in grams.values())
        if held > BROADCAST_BYTES:
            raise ValueError(f"a block's windows take {held} bytes: set block_bytes below {block_bytes}")
        if out is None:
            out = _scan(docs, grams, text, added)
        elif grams:
            found = _scan(docs.select(F.col(text).alias("t")), grams, "t").where("size(spans) > 0")
            found = found.select(F.sha2("t", 256).alias("h"), F.lit(b).alias("b"), "spans", "items")
            more = found if more is None else more.unionByName(found)
    if more is None:
        return out
    # a text has the same hits in a block wherever it stands, so its copies meet as one row before they are joined
    more = more.dropDuplicates(["h", "b"]).groupBy("h").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    h, s, i = fresh(out, "h", "s", "i")
    own = out.columns
    out = out.withColumn(h, F.sha2(text, 256)).join(more.select(F.col("h").alias(h), F.col("s").alias(s), F.col("i").alias(i)), h, "left")
    out = out.withColumn(spans, F.when(F.col(s).isNull(), F.col(spans)).otherwise(F.concat(spans, s))).withColumn(items, F.when(F.col(i).isNull(), F.col(items)).otherwise(F.array_sort(F.array_distinct(F.concat(items, i)))))
    return out.withColumn(spans, F.when(F.col(s).isNull(), F.col(spans)).otherwise(_union_spans(spans))).select(*own)


def _union_spans(name: str):
    """Overlapping or touching word runs joined."""
    first = "cast(array() as array<struct<w0:long,w1:long,b0:long,b1:long>>)"
    return F.expr(
        f"aggregate(array_sort({name}), {first}, (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).w1 >= x.w0,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('w0', element_at(acc, -1).w0, 'w1', greatest(element_at(acc, -1).w1, x.w1), 'b0', element_at(acc, -1).b0, 'b1', greatest(element_at(acc, -1).b1, x.b1)))), concat(acc, array(x))))"
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 0.5, **how) -> DataFrame:
    """`docs` without contamination: hit spans are cut out of the text, and a document that is hit in over `drop_share` of its words goes.

    Spans are byte ranges from the first to the last hit word of a run; what is cut is replaced by one space.
    """
    own = docs.columns
    n_words, spans, items, hit_words = fresh(docs, "n_words", "spans", "items", "hit_words")
    found = scan(docs, benchmark, text, added=(n_words, spans, items), **how)
    cut = F.expr(
        f"concat_ws(' ', transform(sequence(0, size(`{spans}`)), i -> decode(substring(encode(`{text}`, 'utf-8'),"
        f" cast(if(i = 0, 0, `{spans}`[i - 1].b1) + 1 as int), cast(if(i = size(`{spans}`), octet_length(`{text}`), `{spans}`[i].b0) - if(i = 0, 0, `{spans}`[i - 1].b1) as int)), 'utf-8')))"
    )
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s.w1 - s.w0)
    return found.withColumn(hit_words, hit).where(F.col(hit_words) <= drop_share * F.col(n_words)).withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(text))).select(*own)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.w1 - s.w0)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, ws[i:i + least(10, len(ws)) - 1] AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, k, i, ws[i:i + k - 1] AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
