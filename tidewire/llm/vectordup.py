"""Embedding near-dedup by binary codes of randomly rotated vectors.

A code is the signs of a unit vector after a random rotation, stored with a correction factor, the cosine of the vector and its code. The
product of a code with another rotated vector, divided by the factor, is an unbiased estimate of the inner product, and the factor
bounds its error: for certain, and more closely with a stated confidence.

Equal vectors are one class. Codes of several rotations are cut into bands; vectors of a band with equal bits are
compared by all bits, whose differing share is an unbiased estimate of their angle. What lies within its confidence bound is a candidate, and
candidates join vectors into clusters. Within a cluster vectors are taken from a pivot on, their residuals coded anew, and the bounds decide
which pairs are links, which are not, and which need exact recomputation. Of a large cluster only those far from the pivot are compared
with all others in blocks: of those within half the angle of a link any two are linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.graph import components
from tidewire.plans.store import fresh, plan_bytes, save, tasks

#: Cosine of a link.
SIMILAR = 0.95
#: Chance that a pair of just that cosine shares no band; unrelated vectors that agree in a band, about.
MISS, DENSE = 1e-5, 32
#: Standard deviations that an estimate of an angle by all bits, and of an inner product by a code, may be off.
ANGLE_SD, PRODUCT_SD = 5.0, 6.0
#: Bits of all bands together at least, so that unrelated vectors of a small table are told apart too.
LEAST_BITS = 256
#: Rows of a region that one task compares by itself; vectors of a cluster that one task compares, about.
REGION, BLOCK = 8192, 1024
#: What sums of single-precision products may be off by.
SLACK = 1e-4


@lru_cache(maxsize=64)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([95, dim, number]).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def bands(n: int, similar: float = SIMILAR, miss: float = MISS) -> tuple[int, int]:
    """Bits of a band and number of bands for so many vectors: unrelated ones meet about DENSE at a time."""
    bits = max(4, math.ceil(math.log2(max(1, n) / DENSE)))
    return bits, math.ceil(math.log(miss) / math.log1p(-((1 - math.acos(similar) / math.pi) ** bits)))


def most_apart(bits: int, similar: float = SIMILAR) -> int:
    """Differing bits of `bits` that the estimate of a link's angle allows."""
    p = math.acos(similar) / math.pi
    return math.floor(bits * p + ANGLE_SD * math.sqrt(bits * p * (1 - p)))


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large components would overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def coded(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rotated unit vectors, as signs, and their correction factors."""
    return np.where(u >= 0, np.float32(1), np.float32(-1)), np.abs(u).sum(axis=1) / np.sqrt(u.shape[1])


def estimates(signs: np.ndarray, factors: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded (rows) and other rotated vectors (columns)."""
    return (signs @ u.T) / (factors * np.sqrt(u.shape[1]))[:, None]


def bounds(factors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What estimates are off by at most: for certain, and with the confidence of PRODUCT_SD."""
    sure = np.sqrt(np.maximum(0, 1 - factors**2)) / factors
    return sure, sure * min(1.0, PRODUCT_SD / math.sqrt(max(1, dim - 1)))


def linked(q: np.ndarray, a: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, int]:
    """Which rows of `q` are linked to which of `a` (unit vectors), and how many pairs were recomputed exactly."""
    dim = q.shape[1]
    pivot = q.sum(axis=0) + a.sum(axis=0)
    length = np.sqrt((pivot * pivot).sum())
    pivot = pivot / length if length > 0 else np.eye(dim)[0]

    def residual(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        along = x @ pivot
        rest = x - along[:, None] * pivot
        far = np.sqrt((rest * rest).sum(axis=1))
        rest = np.where(far[:, None] > 1e-12, rest / np.maximum(far, 1e-12)[:, None], pivot)
        return along.astype(np.float32), far.astype(np.float32), rest.astype(np.float32) @ rotation(dim, 0)

    (qc, qs, qu), (ac, as_, au) = residual(q), residual(a)
    signs, factors = coded(qu)
    sure, likely = bounds(factors, dim)
    out, again = np.zeros((len(q), len(a)), bool), 0
    for i in range(0, len(q), 256):
        s = slice(i, i + 256)
        wide = qs[s, None] * as_[None, :]
        about = qc[s, None] * ac[None, :] + wide * estimates(signs[s], factors[s], au)
        out[s] = about - wide * sure[s, None] - SLACK >= similar
        x, y = np.nonzero(~out[s] & (about + wide * likely[s, None] + SLACK >= similar))
        for j in range(0, len(x), 1 << 16):
            xs, ys = x[j : j + (1 << 16)] + i, y[j : j + (1 << 16)]
            out[xs, ys] = np.einsum("ij,ij->i", q[xs], a[ys]) >= similar
        again += len(x)
    return out, again


def spanning(link: np.ndarray, q: np.ndarray, a: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links between the keys of rows and columns: (key of a root, key)."""
    out, left, open_ = [], np.ones(len(q), bool), np.ones(len(a), bool)
    for i in range(len(q)):
        if not left[i]:
            continue
        left[i] = False
        rows = np.array([i])
        while len(rows):
            cols = np.flatnonzero(link[rows].any(axis=0) & open_)
            open_[cols] = False
            out += [(int(q[i]), k) for k in a[cols].tolist() if k != q[i]]
            rows = np.flatnonzero(link[:, cols].any(axis=1) & left) if len(cols) else cols
            left[rows] = False
            out += [(int(q[i]), k) for k in q[rows].tolist() if k != q[i]]
    return out


# ---- candidates ----


def codes(x: np.ndarray, bits: int) -> np.ndarray:
    """The first `bits` signs of several rotations of unit vectors (rows x bits)."""
    dim = x.shape[1]
    x = x.astype(np.float32)
    return np.concatenate([x @ rotation(dim, k) >= 0 for k in range(-(-bits // dim))], axis=1)[:, :bits]


def _vectors(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column that has no null."""
    return np.asarray(c.flatten(), np.float64), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())])


def _banded(classes: DataFrame, bits: int, count: int, total: int) -> DataFrame:
    """(ord, skey) of each class and band: dimensions, band, its bits, then all others in an order of the band's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            flat, off = _vectors(rb.column(1))
            keys = rb.column(0).to_numpy()
            for dim in np.unique(np.diff(off)).tolist():
                rows = np.flatnonzero(np.diff(off) == dim)
                for at in range(0, len(rows), 2048):
                    some = rows[at : at + 2048]
                    signs = codes(unit(flat[off[some][:, None] + np.arange(dim)]), total)
                    for band in range(count):
                        turned = np.roll(signs, -band * bits, axis=1)
                        key = np.packbits(turned[:, :bits], axis=1)
                        head = np.tile(np.frombuffer(dim.to_bytes(4) + band.to_bytes(2), np.uint8), (len(some), 1))
                        row = np.concatenate([head, key, np.packbits(turned[:, bits:], axis=1)], axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in row], pa.binary()), pa.array(keys[some])], names=["ord", "skey"])

    return classes.select("skey", "v").mapInArrow(run, "ord binary, skey long")


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as words of 64 bits."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view(np.uint64)


def _forest(code: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the rows whose codes differ in `most` bits at most: (root, row)."""
    n = len(code)
    if n <= 64:
        near = np.bitwise_count(code[:, None] ^ code[None, :]).sum(axis=2) <= most
        if int(near.sum()) == n:
            return []
        return [(x, y) for x, y in spanning(near, np.arange(n), np.arange(n))]
    out, left = [], np.arange(n)
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(code[left] ^ code[queue.pop()]).sum(axis=1) <= most
            if near.any():
                new = left[near].tolist()
                out += [(root, x) for x in new]
                queue += new
                left = left[~near]
    return out


def _region(code: np.ndarray, rest: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Candidates of a whole region in its sorted order: a spanning forest of its rows, of which equal ones are taken once."""
    first = np.concatenate([[True], (rest[1:] != rest[:-1]).any(axis=1)])
    at = np.flatnonzero(first)
    return [(i - 1, i) for i in np.flatnonzero(~first).tolist()] + [(int(at[x]), int(at[y])) for x, y in _forest(code[at], most)]


def _ords(c: pa.Array) -> np.ndarray:
    """A column of equally long binaries as rows of bytes."""
    return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1)


def _apart(q: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Differing bits of each row of `q` and each of `a`."""
    return sum(np.bitwise_count(q[:, k, None] ^ a[None, :, k]).astype(np.uint16) for k in range(q.shape[1]))


def _dense(rows: DataFrame, head: int, most: int) -> DataFrame:
    """Candidate links (a, b) of whole regions of any size (region, ord, skey), no pair left out.

    A region of up to REGION rows is settled by one task. Of a larger one the rows within half of `most` bits of one of them are linked to that one: any two
    of them are candidates. Only the rest is compared with all rows, in blocks.
    """
    sizes = save(rows.groupBy("region").agg(F.count("*").alias("m"), F.min_by(F.struct("ord", "skey"), F.xxhash64("skey")).alias("pivot")), "regions")
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0).cast("long")
    named, links, size = rows.join(sizes.select("region", "m"), "region"), None, 0.0
    units = named.where(f"m <= {REGION}").select("region", zero.alias("i"), zero.alias("j"), "ord", "skey", yes.alias("asks"), yes.alias("answers"))
    if not sizes.where(f"m > {REGION}").isEmpty():

        def cored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                if rb.num_rows:
                    own, pivot = (_words(_ords(rb.column(k))[:, 6:]) for k in (1, 3))
                    core = np.bitwise_count(own ^ pivot).sum(axis=1) <= most // 2
                    yield pa.RecordBatch.from_arrays([*(rb.column(k) for k in (0, 1, 2, 4, 5)), pa.array(core)], names=["region", "ord", "skey", "pivot_key", "m", "core"])

        large = rows.join(sizes.where(f"m > {REGION}"), "region").select("region", "ord", "skey", F.col("pivot.ord").alias("pivot"), F.col("pivot.skey").alias("pivot_key"), "m")
        large = save(large.mapInArrow(cored, "region binary, ord binary, skey long, pivot_key long, m long, core boolean"), "large-regions")
        outside = save(large.groupBy("region").agg(F.count_if(~F.col("core")).alias("n_out"), F.max("m").alias("size")).where("n_out > 0"), "outside")
        block = max(1, REGION // 2)
        blocks = lambda c: F.ceil(F.col(c) / block).cast("long")
        mine = lambda c: F.pmod(F.xxhash64("skey"), blocks(c)).cast("long")
        open_ = large.join(outside, "region")
        asks = open_.where("not core").withColumn("j", F.explode(F.sequence(zero, blocks("size") - 1))).select("region", mine("n_out").alias("i"), "j", "ord", "skey", yes.alias("asks"), no.alias("answers"))
        answers = open_.withColumn("i", F.explode(F.sequence(zero, blocks("n_out") - 1))).select("region", "i", mine("size").alias("j"), "ord", "skey", no.alias("asks"), yes.alias("answers"))
        units = units.unionByName(asks).unionByName(answers)
        links = large.where("core and skey <> pivot_key").select(F.col("pivot_key").alias("a"), F.col("skey").alias("b"))
        copies = outside.agg(F.sum(F.col("n_out") * blocks("size") + F.col("size") * blocks("n_out"))).first()[0] or 0
        size = 128.0 * copies

    def made(o: np.ndarray, k: np.ndarray, asks: np.ndarray, answers: np.ndarray) -> pa.RecordBatch:
        code = _words(o[:, 6:])
        if asks.all() and answers.all():
            at = np.array(_region(code, o[:, head:], most), np.int64).reshape(-1, 2)
            found = k[at]
        else:
            q, a = np.flatnonzero(asks), np.flatnonzero(answers)
            near = np.zeros((len(q), len(a)), bool)
            for x in range(0, len(q), 128):
                near[x : x + 128] = _apart(code[q[x : x + 128]], code[a]) <= most
            found = np.array(spanning(near, k[q], k[a]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for rb in batches:
            if not rb.num_rows:
                continue
            o, k, i, j, asks, answers = _ords(rb.column(3)), rb.column(4).to_numpy(), *(rb.column(c).to_numpy() for c in (1, 2)), *(rb.column(c).to_numpy(zero_copy_only=False) for c in (5, 6))
            change = (o[1:, :head] != o[:-1, :head]).any(axis=1) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            cut = np.flatnonzero(np.concatenate([[True], change, [True]]))
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                unit = (o[x, :head].tobytes(), int(i[x]), int(j[x]))
                if held and unit != now:
                    yield made(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                now = unit
                held.append((o[x:y], k[x:y], asks[x:y], answers[x:y]))
        if held:
            yield made(*(np.concatenate(c) for c in zip(*held, strict=True)))

    parts = tasks(rows.sparkSession, size)
    found = units.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j", "ord").mapInArrow(run, "a long, b long")
    return found if links is None else found.unionByName(links)


def candidates(classes: DataFrame, n: int, similar: float = SIMILAR) -> DataFrame:
    """Candidate links (a, b) of classes (skey, v): a spanning forest of each band's regions, never all pairs.

    Rows are dealt by range of their order. A region that lies within one task and has REGION rows at most is settled there; others, each task's
    first and last region among them, are handed on whole.
    """
    bits, count = bands(n, similar)
    total = max(LEAST_BITS, bits * count)
    head, most = 6 + -(-bits // 8), most_apart(total, similar)
    wide = head + -(-(total - bits) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_o, rest_k, handed = np.zeros((0, wide), np.uint8), np.zeros(0, np.int64), None

        def rows(a, b, o) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(o, pa.binary())], names=["a", "b", "ord"])

        def hand_on(o, k) -> pa.RecordBatch:
            return rows(k, [None] * len(k), [x.tobytes() for x in o])

        for rb in batches:
            if not rb.num_rows:
                continue
            o, k = np.concatenate([rest_o, _ords(rb.column(0))]), np.concatenate([rest_k, rb.column(1).to_numpy()])
            if handed is None:
                handed = o[0, :head].tobytes()  # the task before may have the beginning of the first region
            cut = np.flatnonzero(np.concatenate([[True], (o[1:, :head] != o[:-1, :head]).any(axis=1), [True]])).tolist()
            code, found = _words(o[:, 6:]), []
            for a, b in zip(cut[:-2], cut[1:-1], strict=True):
                if b - a > REGION or (a == 0 and o[0, :head].tobytes() == handed):
                    yield hand_on(o[a:b], k[a:b])
                elif b - a > 1:
                    found += [(a + x, a + y) for x, y in _region(code[a:b], o[a:b, head:], most)]
            if found:
                at = np.array(found, np.int64)
                yield rows(k[at[:, 0]], k[at[:, 1]], [None] * len(at))
            rest_o, rest_k = o[cut[-2] :], k[cut[-2] :]  # the last region may go on in the next batch
            if len(rest_k) > REGION or rest_o[0, :head].tobytes() == handed:
                handed = rest_o[0, :head].tobytes()
                yield hand_on(rest_o, rest_k)
                rest_o, rest_k = rest_o[:0], rest_k[:0]
        if len(rest_k):
            yield hand_on(rest_o, rest_k)  # the task after may have its end

    parts = tasks(classes.sparkSession, float(n) * count * (wide + 16))
    found = _banded(classes, bits, count, total).repartitionByRange(parts, "ord").sortWithinPartitions("ord").mapInArrow(run, "a long, b long, ord binary")
    found = save(found, "candidates")
    dense = found.where("ord is not null").select(F.substring("ord", 1, head).alias("region"), "ord", F.col("a").alias("skey"))
    return found.where("ord is null").select("a", "b").unionByName(_dense(dense, head, most))


# ---- links within clusters ----


def _pivots(large: DataFrame) -> DataFrame:
    """(root, pivot) of clusters: the mean of their unit vectors, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            if not rb.num_rows:
                continue
            flat, off = _vectors(rb.column(1))
            roots = rb.column(0).to_numpy()
            for root in np.unique(roots):
                rows = np.flatnonzero(roots == root)
                total = unit(flat[off[rows][:, None] + np.arange(off[rows[0] + 1] - off[rows[0]])]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(total)), pa.array(np.arange(len(total))), pa.array(total)], names=["root", "place", "x"])

    sums = large.select("root", "v").mapInArrow(run, "root long, place long, x double").groupBy("root", "place").agg(F.sum("x").alias("x"))
    return sums.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("pivot"))  # as many as a vector has


def _cored(large: DataFrame, similar: float) -> DataFrame:
    """Members of large clusters with `core`: whether they are within half a link's angle of the pivot, so that any two of them are linked."""
    half = math.cos(math.acos(similar) / 2 - 1e-7)
    names = [c for c in large.columns if c != "pivot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            (flat, off), (pivots, at) = (_vectors(rb.column(rb.schema.get_field_index(c))) for c in ("v", "pivot"))
            size, core = np.diff(off), np.zeros(rb.num_rows, bool)
            for dim in np.unique(size).tolist():
                rows = np.flatnonzero(size == dim)
                p = pivots[at[rows][:, None] + np.arange(dim)]
                length = np.sqrt((p * p).sum(axis=1))
                core[rows] = (unit(flat[off[rows][:, None] + np.arange(dim)]) * p).sum(axis=1) >= half * np.where(length > 0, length, np.inf)
            yield pa.RecordBatch.from_arrays([*(rb.column(rb.schema.get_field_index(c)) for c in names), pa.array(core)], names=[*names, "core"])

    return large.mapInArrow(run, large.drop("pivot").schema.add("core", "boolean"))


def _compared(units: DataFrame, similar: float, size: float) -> DataFrame:
    """Of units (root, i, j; skey, n, v, asks, answers, back): links (a, b) that span their components, and (a, n): how many vectors are linked to one.

    Rows that ask are compared with rows that answer; those with `back` count the ones that ask too.
    """

    def made(rows: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(rows).combine_chunks()
        skey, n = t["skey"].to_numpy(), t["n"].to_numpy()
        asks, answers, back = (t[c].to_numpy() for c in ("asks", "answers", "back"))
        x = unit(np.asarray(pc_flat(t["v"]), np.float64).reshape(len(skey), -1))
        q, a = np.flatnonzero(asks), np.flatnonzero(answers)
        link, _ = linked(x[q], x[a], similar)
        link &= skey[q][:, None] != skey[a][None, :]
        forest = np.array(spanning(link, skey[q], skey[a]), np.int64).reshape(-1, 2)
        mine, theirs = link @ n[a], n[q] @ link[:, back[a]]
        who = np.concatenate([forest[:, 0], skey[q], skey[a][back[a]]])
        to = pa.array(np.concatenate([forest[:, 1], np.zeros(len(who) - len(forest), np.int64)]), mask=np.arange(len(who)) >= len(forest))
        many = pa.array(np.concatenate([np.zeros(len(forest), np.int64), mine, theirs]), mask=np.arange(len(who)) < len(forest))
        return pa.RecordBatch.from_arrays([pa.array(who), to, many], names=["a", "b", "n"])

    def pc_flat(c: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([np.asarray(k.flatten(), np.float64) for k in c.chunks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for rb in batches:
            if not rb.num_rows:
                continue
            t = pa.table(rb)
            ids = np.stack([rb.column(k).to_numpy() for k in range(3)], axis=1)
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1), [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if rows and tuple(ids[a]) != now:
                    yield made(rows)
                    rows = []
                now = tuple(ids[a])
                rows.append(t.slice(a, b - a))
        if rows:
            yield made(rows)

    parts = tasks(units.sparkSession, size)
    rows = units.select("root", "i", "j", "skey", "n", "v", "asks", "answers", "back")
    return rows.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long, n long")


def confirmed(classes: DataFrame, clusters: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that span the components, and (skey, n_linked): vectors of other classes that are linked to one; classes are (skey, n, v).

    A cluster of up to BLOCK classes is compared by one task. Of a larger one the core, within half a link's angle of the
    mean, is linked without comparison, and what lies outside it is compared with all in blocks.
    """
    sizes = clusters.groupBy("root").agg(F.count("*").alias("m"))
    named = clusters.join(sizes, "root").select(F.col("v").alias("skey"), "root", "m")
    members = save(classes.select("skey", "n", "v").join(named, "skey"), "members")
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0).cast("long")
    units = members.where(f"m <= {BLOCK}").select("root", zero.alias("i"), zero.alias("j"), "skey", "n", "v", yes.alias("asks"), yes.alias("answers"), no.alias("back"))
    size = 4.0 * plan_bytes(units)
    large = members.where(f"m > {BLOCK}")
    links = own = None
    if not large.isEmpty():
        cored = save(_cored(large.join(_pivots(large), "root"), similar), "cored")
        out = cored.groupBy("root").agg(F.count_if(~F.col("core")).alias("n_out"), F.sum(F.when(F.col("core"), F.col("n"))).alias("core_n"), F.min(F.when(F.col("core"), F.col("skey"))).alias("core_least"), F.count("*").alias("size"))
        out = save(out, "cores")
        rows = cored.join(out, "root")
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        each = lambda c: F.explode(F.sequence(zero, (blocks(c) - 1).cast("long")))
        mine = lambda c: F.pmod(F.xxhash64("skey"), blocks(c)).cast("long")
        open_ = rows.where("n_out > 0")
        asks = open_.where("not core").withColumn("j", each("size")).select("root", mine("n_out").alias("i"), "j", "skey", "n", "v", yes.alias("asks"), no.alias("answers"), no.alias("back"))
        answers = open_.withColumn("i", each("n_out")).select("root", "i", mine("size").alias("j"), "skey", "n", "v", no.alias("asks"), yes.alias("answers"), F.col("core").alias("back"))
        units = units.unionByName(asks).unionByName(answers)
        size += 4.0 * plan_bytes(members) * (out.agg(F.max(blocks("n_out"))).first()[0] or 0)
        links = rows.where("core and skey <> core_least").select(F.col("core_least").alias("a"), F.col("skey").alias("b"))
        own = rows.where("core").select("skey", (F.col("core_n") - F.col("n")).alias("n"))
    found = save(_compared(units, similar, size), "found")
    edges, counts = found.where("b is not null").select("a", "b"), found.where("b is null").select(F.col("a").alias("skey"), "n")
    if links is not None:
        edges, counts = edges.unionByName(links), counts.unionByName(own)
    return edges, counts.groupBy("skey").agg(F.sum("n").alias("n_linked"))


def groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", similar: float = SIMILAR) -> DataFrame:
    """Every row of `vectors` with n_links, component_id, kept and link_group.

    n_links counts the other rows whose cosine is `similar` or more, in double precision; component_id is the least key reachable by links, and
    kept says whether it is the row's own. Null, empty and zero vectors and those that hold a null or a non-finite component link with nothing,
    nor do vectors of unequal length. A repeated row is a vector as often as it comes, and links with its likes. A null
    key names no component while another member has one. link_group tells components apart, those without keys too; it is null for vectors that
    link with nothing by rule. Columns of `vectors` named like an added one are replaced.
    """
    added = ("n_links", "component_id", "kept", "link_group")
    if clash := {key, vector} & set(added):
        raise ValueError(f"rename {sorted(clash)}: the operator adds columns of these names")
    own = vectors.drop(*added)
    ka, kb, least = fresh(own, "ka", "kb", "least")
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    valid = F.coalesce((F.size(x) > 0) & ~odd & F.exists(x, lambda c: c != 0), F.lit(False))
    rows = own.withColumn(ka, F.when(valid, F.xxhash64(x))).withColumn(kb, F.when(valid, F.xxhash64(F.lit("second"), x)))
    classes = rows.where(F.col(ka).isNotNull()).groupBy(ka, kb).agg(F.count("*").alias("n"), F.min(key).alias(least), F.first(vector).alias("v"))
    classes = save(classes.withColumn("skey", F.monotonically_increasing_id()), "classes")
    clusters = save(components(candidates(classes, classes.count(), similar)), "clusters")
    edges, counts = confirmed(classes, clusters, similar)
    parts = save(components(edges), "parts")
    named = classes.select(F.col("skey").alias("v"), least).join(parts, "v")
    named = named.select("v", "root").join(named.groupBy("root").agg(F.min(least).alias("component_id")), "root")
    said = classes.select("skey", ka, kb, "n", least).join(counts, "skey", "left").join(named.withColumnRenamed("v", "skey"), "skey", "left")
    n_links = F.col("n") - 1 + F.coalesce("n_linked", F.lit(0))
    # a class of one vector that links with nothing needs no row here
    said = said.select(ka, kb, n_links.alias("n_links"), F.coalesce("component_id", least).alias("component_id"), F.coalesce("root", "skey").alias("link_group"))
    out = rows.join(said, [ka, kb], "left").drop(ka, kb)
    out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("component_id", F.coalesce("component_id", key))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", similar: float = SIMILAR) -> DataFrame:
    """One row of each component, with the columns of `vectors`; vectors that link with nothing by rule all stay."""
    found = groups(vectors, key, vector, similar).where("kept")
    return found.where("link_group is not null").dropDuplicates(["link_group"]).unionByName(found.where("link_group is null")).select(*vectors.columns)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return groups(vectors).select("vec_id", "n_links", "component_id", "kept")


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {SIMILAR}),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r AS (SELECT DISTINCT a AS vec_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
