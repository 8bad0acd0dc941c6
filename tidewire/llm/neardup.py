"""MinHash near-dedup with an LSH forest.

Every distinct shingle set gets one signature. The forest holds several sorted orders of the signatures (each
begins at another place of the signature), dealt out by range, so that a dense region spreads over many tasks.
Within a region (a common prefix of the order) candidates are longest-common-prefix neighbours; a region that is
too large is split at the next value of the order, as deep as it needs. Candidates join documents into clusters,
and links are confirmed on the full shingle sets within each cluster: of a small one all at once, of a larger one block by block,
of a very large one (pages of one template, say, which are alike but no links) in the regions of a second, finer forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import _text as X
from tidewire.operators.graph import components
from tidewire.plans.store import fresh, plan_bytes, save, tasks

#: Shingle length in words and the similarity of a link, in hundredths.
WORDS, SIMILAR = 5, 75
#: Values of a signature, trees of the forest, values that a region has in common at least.
VALUES, TREES, DEPTH = 64, 16, 2
#: Rows that one region compares at once; a larger one is split by deeper values.
REGION = 2048
#: Documents of a cluster that one task verifies, about; a larger cluster is verified in blocks, then by pairs of blocks.
BLOCK = 512
#: Blocks of a cluster that are confirmed pair by pair at most, so many copies of a text; a cluster of more is read by the finer forest.
PAIRS = 64
#: Values of the finer forest at least, chance that a pair of similarity 0.75 shares none of its regions, and trees of one round.
FINE_DEPTH, FINE_MISS, FINE_ROUND = 6, 4e-6, 32
#: Sketch values in common from which two rows are candidates: 0.75 of 64 less four and a half standard deviations.
LEAST_COMMON = 32

_rng = np.random.default_rng(75)
_MUL = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | X.U(1)
_ADD = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_OTHER = X.U(0xA24BAED4963EE407)


def signature(sets: list[np.ndarray], mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    """Minima of hash functions over each non-empty set, as 32 bits (rows x functions)."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(mul)), np.uint32)
    for k in range(len(mul)):
        h = flat * mul[k] + add[k]
        out[:, k] = (np.minimum.reduceat(h ^ (h >> X.U(29)), at) >> X.U(32)).astype(np.uint32)
    return X.mix(out.astype(np.uint64) + np.arange(len(mul), dtype=np.uint64) * X.U(1 << 32)).astype(np.uint32)


def _row(key: str, text: str) -> tuple[Column, Column]:
    """128 bits by which a row of an id and a text is known."""
    return F.xxhash64(F.col(key), F.col(text)).alias("row"), F.xxhash64(F.lit("second"), F.col(text), F.col(key)).alias("rowb")


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, rowb, n, ka, kb, sig) of each row: its id, hash of id and text, the size and a hash of its shingle set (128 bits each), its signature (null if empty)."""
    rows = docs.select(F.col(key).cast("long").alias("id"), *_row(key, text), F.col(text).alias("text"))
    names = ["id", "row", "rowb", "n", "ka", "kb", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, buf, off in X.pieces(rb, "text"):
                sets = X.shingle_sets(buf, off, WORDS)
                size = np.array([len(s) for s in sets], np.int64)
                ka, kb = (np.array([int(X.mix(s ^ turn).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64) for turn in (X.U(0), _OTHER))
                full = np.flatnonzero(size)
                sig: list[bytes | None] = [None] * len(sets)
                if len(full):
                    for r, s in zip(full.tolist(), signature([sets[r] for r in full]), strict=True):
                        sig[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays([*(rb.column(c).slice(i, j - i) for c in range(3)), pa.array(size), pa.array(ka), pa.array(kb), pa.array(sig, pa.binary())], names=names)

    return rows.mapInArrow(run, "id long, row long, rowb long, n long, ka long, kb long, sig binary")


def _forest(classes: DataFrame) -> DataFrame:
    """(ord, skey) of each class and tree: ord is the tree, DEPTH whole values, then a byte of every value, in the tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = VALUES // TREES
        for rb in batches:
            if not rb.num_rows:
                continue
            sig = np.frombuffer(b"".join(rb.column(1).to_pylist()), np.uint32).reshape(-1, VALUES)
            for t in range(TREES):
                turned = np.roll(sig, -t * step, axis=1)
                whole = turned[:, :DEPTH].astype(">u4").view(np.uint8).reshape(len(sig), -1)
                row = np.concatenate([np.full((len(sig), 1), t, np.uint8), whole, (turned & 0xFF).astype(np.uint8)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in row], pa.binary()), rb.column(0)], names=["ord", "skey"])

    return classes.select("skey", "sig").mapInArrow(run, "ord binary, skey long")


def _joined(sketch: np.ndarray, least: int = LEAST_COMMON) -> list[tuple[int, int]]:
    """A spanning forest of the rows whose sketches have `least` values in common: (root, row)."""
    out = []
    left = np.arange(len(sketch))
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            near = (sketch[left] == sketch[queue.pop()]).sum(axis=1) >= least
            if near.any():
                new = left[near].tolist()
                out += [(root, x) for x in new]
                queue += new
                left = left[~near]
    return out


def _region(sketch: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Candidates of a region in its sorted order; adaptive: a large region is split where its next value changes."""
    n = len(sketch)
    if n <= REGION:
        return _joined(sketch)
    if depth >= VALUES:
        return [(i - 1, i) for i in range(1, n)]  # one and the same signature
    out = []
    cut = np.flatnonzero(np.concatenate([[True], sketch[1:, depth] != sketch[:-1, depth], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        out += [(a + x, a + y) for x, y in _region(sketch[a:b], depth + 1)]
    near = np.flatnonzero((sketch[1:] == sketch[:-1]).sum(axis=1) >= LEAST_COMMON)
    return out + [(i, i + 1) for i in near.tolist()]


def candidates(classes: DataFrame) -> DataFrame:
    """Candidate links (a, b) of classes (skey, sig): a spanning forest of each region, never all its pairs."""
    spark = classes.sparkSession
    head = 1 + 4 * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_o, rest_k = np.zeros((0, head + VALUES), np.uint8), np.zeros(0, np.int64)

        def links(o, k):
            if not len(k):
                return None
            change = (o[1:, :head] != o[:-1, :head]).any(axis=1)
            cut = np.flatnonzero(np.concatenate([[True], change, [True]]))
            found = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    found += [(a + x, a + y) for x, y in _region(o[a:b, head:], DEPTH)]
            if not found:
                return None
            at = np.array(found)
            return pa.RecordBatch.from_arrays([pa.array(k[at[:, 0]]), pa.array(k[at[:, 1]])], names=["a", "b"])

        for rb in batches:
            if not rb.num_rows:
                continue
            o = np.concatenate([rest_o, np.frombuffer(b"".join(rb.column(0).to_pylist()), np.uint8).reshape(rb.num_rows, -1)])
            k = np.concatenate([rest_k, rb.column(1).to_numpy()])
            same = (o[:, :head] == o[-1, :head]).all(axis=1)
            last = int(np.argmax(same))  # the last region may go on in the next batch
            if len(o) - last > 8 * REGION:  # a very dense region is read in overlapping stretches of its order
                last = len(o) - REGION
                done = len(o)
            else:
                done = last
            if (made := links(o[:done], k[:done])) is not None:
                yield made
            rest_o, rest_k = o[last:], k[last:]
        if (made := links(rest_o, rest_k)) is not None:
            yield made

    n = tasks(spark, classes.count() * TREES * (head + VALUES + 8))
    return _forest(classes).repartitionByRange(n, "ord").sortWithinPartitions("ord").mapInArrow(run, "a long, b long")


def _confirmed(keys: list[int], sets: list[np.ndarray], similar: int = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the links on full sets: (key of a root, key)."""
    out = []
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    top = int(flat.max()) + 1
    size = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    mine = [flat[at[i] : at[i + 1]] for i in range(len(sets))]
    left = np.arange(len(sets))
    mark = np.zeros(top, bool)
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        pack, pack_at, packed = np.concatenate([mine[i] for i in left]), np.concatenate([[0], np.cumsum(size[left])[:-1]]), left
        while queue and len(left):
            if len(left) * 2 < len(packed):
                pack, pack_at, packed = np.concatenate([mine[i] for i in left]), np.concatenate([[0], np.cumsum(size[left])[:-1]]), left
            x = queue.pop()
            mark[mine[x]] = True
            both = np.add.reduceat(mark[pack].astype(np.int64), pack_at)
            mark[mine[x]] = False
            near = packed[100 * both >= similar * (size[x] + size[packed] - both)]
            near = near[np.isin(near, left)]
            if len(near):
                out += [(keys[root], keys[i]) for i in near.tolist()]
                queue += near.tolist()
                left = left[~np.isin(left, near)]
    return out


def verify(members: DataFrame, size: float = 0) -> DataFrame:
    """Confirmed links (a, b) within each group of `members` (grp, skey, text; `size` bytes, about), on full shingle sets."""

    def links(seen: dict[int, bytes]):
        if len(seen) < 2:
            return None
        buf = np.frombuffer(b"".join(seen.values()), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for t in seen.values()])])
        found = _confirmed(list(seen), X.shingle_sets(buf, off, WORDS))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, {}
        for rb in batches:
            for g, k, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if g != now:
                    if (made := links(rows)) is not None:
                        yield made
                    now, rows = g, {}
                rows.setdefault(k, t or b"")  # a repeated row is held once
        if (made := links(rows)) is not None:
            yield made

    n = tasks(members.sparkSession, size)
    return members.select("grp", "skey", "text").repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def _named(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("v").alias("skey"), F.col("root").alias("part"))


def _blocked(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """(skey, grp) of the groups (skey, grp) that aren't one component by now, large ones as all pairs of their blocks."""
    named = groups.join(_named(parts), "skey", "left").withColumn("part", F.coalesce("part", "skey"))
    open_ = named.groupBy("grp").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p <> q")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = groups.join(open_.select("grp", blocks.alias("nb")), "grp").withColumn("b", F.pmod(F.xxhash64("skey", "grp"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select("skey", F.xxhash64("grp", F.least("b", "o"), F.greatest("b", "o"), F.lit("pair")).alias("grp"))


def fine(blocks: int) -> tuple[int, int]:
    """Values and trees of the finer forest for a cluster of so many blocks.

    Rows that are alike in half of their shingles, which is the least that makes them candidates, then meet about BLOCK at a time. A text
    has as many copies as there are trees, so about the 0.42th power of the blocks.
    """
    depth = max(FINE_DEPTH, math.ceil(math.log2(max(1, blocks))))
    return depth, math.ceil(math.log(FINE_MISS) / math.log1p(-((SIMILAR / 100) ** depth)))


def _fine(held: DataFrame, depth: int, first: int, last: int) -> DataFrame:
    """(skey, grp): the regions of the finer forest's trees from `first` up to `last`, within each cluster, that hold two rows or more."""
    functions = np.random.default_rng([75, depth, first]).integers(1, 1 << 63, (2, (last - first) * depth), dtype=np.uint64)
    mul, add = functions[0] | X.U(1), functions[1]
    weight = np.array([pow(int(_OTHER) | 1, k + 1, 1 << 64) for k in range(depth)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, buf, off in X.pieces(rb, "text"):
                sig = signature(X.shingle_sets(buf, off, WORDS), mul, add).astype(np.uint64).reshape(j - i, last - first, depth)
                root = rb.column(1).slice(i, j - i).to_numpy().view(np.uint64)
                grp = X.mix((sig * weight).sum(axis=2) + X.mix(root)[:, None] + np.arange(first, last, dtype=np.uint64)[None, :] * _OTHER)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rb.column(0).slice(i, j - i).to_numpy(), last - first)), pa.array(grp.ravel().view(np.int64))], names=["skey", "grp"])

    rows = save(held.select("skey", "root", "text").mapInArrow(run, "skey long, grp long"), "regions")
    return rows.join(rows.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1").select("grp"), "grp", "left_semi")


def confirmed(held: DataFrame, where: DataFrame) -> DataFrame:
    """(v, root): components of the confirmed links within clusters; `where` has (skey, root, nb, b), `held` the texts too.

    First within blocks; the least row of a cluster visits all its blocks. Then, of the clusters that aren't one component by now,
    all pairs of blocks, or the finer forest's regions for those of over PAIRS blocks. A region that is larger than a block even so is
    read by pairs of blocks too.
    """
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    inside = held.withColumn("b", F.explode(F.when(F.col("skey") == F.col("root"), every).otherwise(F.array("b"))))
    size = 4.0 * plan_bytes(held)  # as files it is compressed to about a quarter
    each = size / max(1, held.count())
    links = save(verify(inside.select("skey", "text", F.xxhash64("root", "b").alias("grp")), 2 * size), "confirmed")
    parts = components(links)
    most = where.agg(F.max("nb")).first()[0] or 1
    if most > 1:
        pairs = save(_blocked(where.where(f"nb > 1 and nb <= {PAIRS}").select("skey", F.col("root").alias("grp")), parts), "pairs")
        if not pairs.isEmpty():
            links = links.unionByName(save(verify(held.select("skey", "text").join(pairs, "skey"), each * pairs.count()), "confirmed"))
            parts = components(links)
    depth, trees = fine(most)
    for first in range(0, trees if most > PAIRS else 0, FINE_ROUND):
        regions = save(_blocked(_fine(held.where(f"nb > {PAIRS}"), depth, first, min(trees, first + FINE_ROUND)), parts), "pairs")
        if not regions.isEmpty():
            links = links.unionByName(save(verify(held.select("skey", "text").join(regions, "skey"), each * regions.count()), "confirmed"))
            parts = components(links)
    return parts


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, rowb, n_shingles, component_id, root, kept) of every row: near-duplicate groups by links of Jaccard 0.75 or more.

    component_id is the least id reachable. Null, empty or wordless texts have no shingles and are groups of
    their own. Rows with equal shingle sets are one class, whatever their number; a repeated row is in its class as often
    as it comes. Sets are equal if 128 bits of hash are; a class is then known by a number of its own. A null id counts as no id: it is never
    a component's name while another member has one. root tells components apart, those of null ids too (null without shingles).
    """
    sig = save(signatures(docs, key, text), "signatures")
    classes = sig.where("n > 0").groupBy("ka", "kb").agg(F.min("id").alias("least"), F.min(F.struct("row", "rowb")).alias("r"), F.min("sig").alias("sig"))
    classes = save(classes.select(F.monotonically_increasing_id().alias("skey"), "ka", "kb", "least", "r.row", "r.rowb", "sig"), "classes")
    clusters = save(components(candidates(classes)), "clusters")
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    where = clusters.join(sizes, "root").join(classes.select(F.col("skey").alias("v"), "row", "rowb"), "v").select("row", "rowb", F.col("v").alias("skey"), "root", blocks.alias("nb"))
    where = save(where.withColumn("b", F.pmod(F.xxhash64("skey"), F.col("nb")).cast("int")), "members")
    texts = docs.select(*_row(key, text), F.col(text).alias("text"))
    # what is looked up grows with the corpus, so it is never broadcast; texts are fetched once for all passes, repeated rows once
    held = save(texts.join(where.hint("merge"), ["row", "rowb"]).select("skey", "root", "nb", "b", "text"), "texts")
    parts = confirmed(held, where)
    least = classes.select("skey", "ka", "kb", "least").join(parts.select(F.col("v").alias("skey"), "root"), "skey", "left").select("ka", "kb", "least", F.coalesce("root", "skey").alias("root"))
    least = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("ka", "kb", "root", "component_id")
    out = sig.drop("sig").withColumns({k: F.when(F.col("n") > 0, F.col(k)) for k in ("ka", "kb")}).join(least, ["ka", "kb"], "left")
    out = out.select("id", "row", "rowb", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "root")
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate group (of the least id, or of none if all are null), with the columns of `docs`.

    Of several texts of that id the one of the least hash stays; of equal (id, text) rows the one of the least hash of all columns, texts without shingles too.
    """
    group = ("root", *(F.when(F.col("root").isNull(), F.col(c)).alias(f"_{c}") for c in ("row", "rowb")))
    keep = groups(docs, key, text).where("kept").groupBy(*group).agg(F.min(F.struct("row", "rowb")).alias("r")).select("r.row", "r.rowb")
    row, rowb, one = fresh(docs, "_row", "_rowb", "_one")
    # copies of a row are one before they are joined, so that a row of any number meets no single task
    a, b = _row(key, text)
    each = docs.groupBy(a.alias(row), b.alias(rowb)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(one))
    return each.join(keep.select(F.col("row").alias(row), F.col("rowb").alias(rowb)), [row, rowb], "left_semi").select(f"{one}.*")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return groups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT DISTINCT a AS doc_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, doc_id) AS component_id, coalesce(c.c, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
