"""Suffix-array dedup: bytes covered by long strings that also start elsewhere.

A sparse suffix array over content-chosen anchors. Of every run of WIDTH consecutive k-byte strings the least hash
is an anchor, so two equal strings of LEAST bytes have an anchor at the same place. The steps:

1. Anchors whose first k bytes occur once in the corpus can't be in a repeat. A fingerprint of these bytes is
   exchanged (as in prefix-doubling string sorting); each batch sends a fingerprint once however often it holds it.
   A passage in a large part of all texts would still meet in one task later on; the few fingerprints that come that often are
   settled by hashes of the windows around them, counted with the same pre-aggregation.
2. The other anchors get their suffix (LEAST bytes) and the bytes before it. Each batch sorts its suffixes and sends
   the sorted run front-coded (length of the prefix in common with the suffix before, and the rest), dealt by a hash of the first
   K bytes: suffixes that differ there share no repeat, so no order over all buckets is needed, and none is skewed by frequent prefixes.
3. Each bucket merges its runs with a loser tree that keeps the known common prefix of every contender, so no byte is
   compared twice. The merge gives the bucket's suffix array and its LCP array.
4. Per anchor the repeated windows around it follow from the intervals of the LCP array and, inside an interval, from
   neighbours in the order of the bytes before (longest common extension to the left).
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import _text as X
from tidewire.plans.store import fresh, plan_bytes, save, tasks

#: Bytes of a repeated string; bytes of an anchor's fingerprint.
LEAST, K = 200, 48
#: Hashes of which the least is an anchor; bytes before an anchor that matter.
WIDTH, BEFORE = LEAST - K + 1, LEAST - K
_BASE = X.U(0xD6E8FEB86659FD93)
_WEIGHT = np.array([pow(int(_BASE), K - 1 - j, 1 << 64) for j in range(K)], np.uint64)
#: Places of one fingerprint beyond which it isn't settled in one task: the windows around them are then asked for one by one.
HOT = 200_000
#: Hot fingerprints that are broadcast at most.
HOT_LIST = 500_000
#: Another reading of the bytes, for a second hash.
_TURNED = np.random.default_rng(200).permutation(256).astype(np.uint8)
#: Bytes of text whose strings are hashed at once; below 2^24.
STRETCH = 8 << 20
#: Documents' bytes of one sorted run; buckets of the exchange for each of its tasks.
RUN_BYTES, RANGES = 8 << 20, 4
#: Bytes of a front-coded suffix with the bytes before it, about.
SUFFIX_BYTES = 120


def _rolling(buf: np.ndarray) -> np.ndarray:
    """Hashes of all K-byte strings of the buffer."""
    total = len(buf) - K + 1
    out = None
    h, size, done, power = X._LETTER[buf], 1, 0, int(_BASE)
    todo = K
    while todo:  # by doubling: strings of 1, 2, 4, ... bytes
        if todo & 1:
            part = h[done : done + total]
            out = part.copy() if out is None else out * X.U(pow(int(_BASE), size, 1 << 64)) + part
            done += size
        todo >>= 1
        if todo:
            h = h[:-size] * X.U(power) + h[size:]
            power = power * power % (1 << 64)
            size *= 2
    return X.mix(out)


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints of the anchors of all texts; equal windows choose equal anchors (the leftmost on ties)."""
    n = len(buf)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > STRETCH:  # a very long text, by itself: stretches that overlap by what a window needs
        at, fp = zip(*(anchors(part, np.array([0, len(part)])) for part in (buf[a : a + STRETCH] for a in range(0, n - LEAST + 1, STRETCH - LEAST + 1))), strict=True)
        at, first = np.unique(np.concatenate([x + k * (STRETCH - LEAST + 1) for k, x in enumerate(at)]), return_index=True)
        return at, np.concatenate(fp)[first]
    h = _rolling(buf)
    low = X.U((1 << 24) - 1)  # places in a stretch; the same for texts of all lengths, so that all choose alike
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= WIDTH:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < WIDTH:
        m = np.minimum(m[: len(m) - (WIDTH - size)], m[WIDTH - size :])
    at = (m & low).astype(np.int64)  # the anchor of the window that starts here
    inside = np.zeros(n + 1, np.int64)  # windows that cross a text's end have none
    long = np.diff(off) >= LEAST
    np.add.at(inside, off[:-1][long], 1)
    np.add.at(inside, off[1:][long] - LEAST + 1, -1)
    at = at[np.cumsum(inside)[: len(at)] > 0]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    at = np.unique(at)
    return at, h[at]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(did, th, tb, text): rows are told apart by 128 bits of hash of id and text. Half of them suffices to find places, for what is found there is compared byte by byte."""
    return docs.select(F.col(key).cast("long").alias("did"), *_row(key, text), F.col(text).alias("text"))


def _row(key: str, text: str) -> tuple[Column, Column]:
    return F.xxhash64(F.col(key), F.col(text)).alias("th"), F.xxhash64(F.lit("second"), F.col(text), F.col(key)).alias("tb")


def _asked(fp: np.ndarray, fp2: np.ndarray, who: np.ndarray, whob: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """(pk, pk2, th, tb, pos, m) of a batch's fingerprints, so that each is asked for once: m is -1 for a place that is known to repeat
    within the batch, 1 for one that asks, and the number of its places for the one that stands for a known fingerprint."""
    order = np.lexsort((fp2, fp))
    f, g = fp[order], fp2[order]
    first = np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])]) if len(f) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    size = np.diff(np.concatenate([at, [len(f)]]))
    known = np.repeat(size > 1, size) if len(f) else first
    rows = np.concatenate([order[known], order[at]])
    m = np.concatenate([np.full(int(known.sum()), -1), size]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(fp[rows].view(np.int64)), pa.array(fp2[rows].view(np.int64)), pa.array(who[rows]), pa.array(whob[rows]), pa.array(pos[rows].astype(np.int32)), pa.array(m)], names=["pk", "pk2", "th", "tb", "pos", "m"])


_ASKED = "pk long, pk2 long, th long, tb long, pos int, m int"


def _fingerprints(rows: DataFrame) -> DataFrame:
    """What is asked for the anchors of all texts: the hash of an anchor's first K bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ths = rb.column(0).to_numpy()
            fps, who, pos = [], [], []
            for i, _, buf, off in X.pieces(rb, "text", 1 << 20):
                at, fp = anchors(buf, off)
                d = np.searchsorted(off, at, "right") - 1
                fps.append(fp)
                who.append(ths[i + d])
                pos.append(at - off[d])
            if fps:
                fp = np.concatenate(fps)
                yield _asked(fp, np.zeros_like(fp), np.concatenate(who), np.zeros(len(fp), np.int64), np.concatenate(pos))

    return rows.select("th", "text").mapInArrow(run, _ASKED)


def _repeated(asked: DataFrame, hot: int, n: int) -> DataFrame:
    """(th, tb, pos, fp) of the places whose fingerprint comes at least twice, and a row without a place for each fingerprint of over `hot` places.

    At most one row of a fingerprint comes from each batch; known places don't travel to where their fingerprint is settled.
    """

    names = ["th", "tb", "pos", "fp"]

    def settled(c: list[np.ndarray]) -> pa.RecordBatch:
        pk, pk2, th, tb, pos, m = c
        first = np.concatenate([[True], (pk[1:] != pk[:-1]) | (pk2[1:] != pk2[:-1])])
        at = np.flatnonzero(first)
        size = np.diff(np.concatenate([at, [len(pk)]]))
        keep = np.repeat(size > 1, size) & (m == 1)
        over = pk[at[np.add.reduceat(m.astype(np.int64), at) > hot]]
        none = [None] * len(over)
        return pa.RecordBatch.from_arrays([pa.array([*th[keep].tolist(), *none], pa.int64()), pa.array([*tb[keep].tolist(), *none], pa.int64()), pa.array([*pos[keep].tolist(), *none], pa.int32()), pa.array(np.concatenate([pk[keep], over]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for rb in batches:
            c = [x.to_numpy() for x in rb.columns]
            known = c[5] < 0
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[k][known]) for k in (2, 3, 4, 0)], names=names)
            c = [x[~known] for x in c]
            if rest is not None:
                c = [np.concatenate([a, b]) for a, b in zip(rest, c, strict=True)]
            if not len(c[0]):
                continue
            last = int(np.searchsorted(c[0], c[0][-1]))  # this key may go on
            if last:
                yield settled([x[:last] for x in c])
            rest = [x[last:] for x in c]
        if rest is not None and len(rest[0]):
            yield settled(rest)

    where = F.when(F.col("m") < 0, F.col("th")).otherwise(F.col("pk"))
    return asked.repartition(n, where).sortWithinPartitions("pk", "pk2").mapInArrow(run, "th long, tb long, pos int, fp long")


def _windows(joined: DataFrame) -> DataFrame:
    """What is asked for every window around anchors (th, tb, text, places): 128 bits of hash of its LEAST bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ths, tbs = rb.column(0).to_numpy(), rb.column(1).to_numpy()
            for i, j, buf, off in X.pieces(rb, "text"):
                starts = []
                for d, places in zip(range(j - i), rb.column(3).slice(i, j - i), strict=True):
                    near = np.unique((places.values.to_numpy().astype(np.int64)[:, None] - np.arange(BEFORE + 1)[None, :]).ravel())
                    near = near[(near >= 0) & (near + LEAST <= off[d + 1] - off[d])]
                    starts.append(near + off[d])
                at = np.concatenate(starts)
                d = np.searchsorted(off, at, "right") - 1
                h = X.spans_hash(buf, at, at + LEAST)
                yield _asked(h, X.spans_hash(_TURNED[buf], at, at + LEAST), ths[i + d], tbs[i + d], at - off[d])

    return joined.select("th", "tb", "text", "places", "did").mapInArrow(run, _ASKED)


def _gather(buf: np.ndarray, starts: np.ndarray, size: np.ndarray, wide: int, back: bool) -> np.ndarray:
    """Rows of bytes from each start on, or backwards from the byte before it; beyond `size` 0xFF, which UTF-8 never has."""
    j = np.arange(wide)
    at = starts[:, None] + (-1 - j if back else j)[None, :]
    out = buf[np.clip(at, 0, len(buf) - 1)]
    out[j[None, :] >= size[:, None]] = 0xFF
    return out


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, `most` at the most."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def _order(right: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(right).view(f"V{right.shape[1]}").ravel(), kind="stable")


def encode(right: np.ndarray, rlen: np.ndarray, left: np.ndarray, llen: np.ndarray, th: np.ndarray, tb: np.ndarray, pos: np.ndarray) -> bytes:
    """A sorted run of suffixes, front-coded: what each has in common with the one before is not sent."""
    n = len(right)
    lcp = np.zeros(n, np.uint8)
    lcp[1:] = _common(right[1:], right[:-1], np.minimum(rlen[1:], rlen[:-1]))
    j = np.arange(LEAST)
    tails = right[(j[None, :] >= lcp[:, None]) & (j[None, :] < rlen[:, None])]
    lefts = left[np.arange(BEFORE)[None, :] < llen[:, None]]
    parts = [np.array([n], np.int64), lcp, rlen.astype(np.uint8), llen.astype(np.uint8), th.astype(np.int64), tb.astype(np.int64), pos.astype(np.int32), tails, lefts]
    return b"".join(p.tobytes() for p in parts)


def decode(block: bytes):
    """The run of `encode`: lcp, rlen, llen, th, tb, pos, suffixes as bytes, bytes before as rows."""
    raw = io.BytesIO(block)
    get = lambda kind, n: np.frombuffer(raw.read(np.dtype(kind).itemsize * n), kind)
    n = int(get(np.int64, 1)[0])
    lcp, rlen, llen = (get(np.uint8, n).astype(np.int64) for _ in range(3))
    th, tb, pos = get(np.int64, n), get(np.int64, n), get(np.int32, n)
    tails = raw.read(int((rlen - lcp).sum()))
    left = np.full((n, BEFORE), 0xFF, np.uint8)
    mask = np.arange(BEFORE)[None, :] < llen[:, None]
    left[mask] = np.frombuffer(raw.read(int(llen.sum())), np.uint8)
    out, at, before = [], 0, b""
    for c, r in zip(lcp.tolist(), rlen.tolist(), strict=True):
        before = before[:c] + tails[at : at + r - c]
        at += r - c
        out.append(before)
    return lcp, rlen, llen, th, tb, pos, out, left


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (strings, their LCPs) with a loser tree: ((run, index) in order, LCP with the string before).

    Every contender carries its common prefix with the last winner. A longer one wins without a comparison; equal ones
    are compared from there on, so a known prefix is never compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    size = [len(s) for s, _ in runs] + [0] * (k - len(runs))
    at = [0] * k
    head: list[bytes | None] = [runs[r][0][0] if size[r] else None for r in range(k)]
    lcp = [0] * k  # of each run's head with the last winner
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner, loser."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = lcp[a], lcp[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        n = min(len(x), len(y))
        step = 8
        while p < n and x[p : p + step] == y[p : p + step]:
            p += step
            step *= 2
        if p >= n:
            p = n
        else:  # the first difference lies within the last stretch
            lo, hi = p, min(p + step, n)
            while lo < hi:
                mid = (lo + hi) // 2
                if x[lo : mid + 1] == y[lo : mid + 1]:
                    lo = mid + 1
                else:
                    hi = mid
            p = lo
        if x[p : p + 1] <= y[p : p + 1] and (p < n or len(x) <= len(y)):
            lcp[b] = p
            return a, b
        lcp[a] = p
        return b, a

    tree = [0] * (2 * k)
    for r in range(k):
        tree[k + r] = r
    for node in range(k - 1, 0, -1):
        tree[node], loser[node] = play(tree[2 * node], tree[2 * node + 1])
    top = tree[1]
    order, lcps = [], []
    for _ in range(sum(size)):
        order.append((top, at[top]))
        lcps.append(lcp[top])
        at[top] += 1
        i = at[top]
        if i < size[top]:
            head[top] = runs[top][0][i]
            lcp[top] = runs[top][1][i]
        else:
            head[top] = None
        node = (k + top) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2
    if lcps:
        lcps[0] = 0
    return order, lcps


def reach(lcp: np.ndarray, rlen: np.ndarray, left: np.ndarray, llen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of the array the range (first, last) of d for which the LEAST bytes from d before it occur again; first > last: none.

    At depth r the suffixes of one LCP interval agree in r bytes; the longest agreement before the anchor, f, is with a
    neighbour in the order of the bytes before. Windows of d in [LEAST - r, f] repeat. An interval needs looking at only at its
    own depth, since a smaller depth with the same members shows nothing new.
    """
    n = len(rlen)
    first, last = np.full(n, LEAST, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return first, last
    by_left = _order(left)
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    ls, ll = left[by_left], llen[by_left]
    table = [_common(ls[1:], ls[:-1], np.full(n - 1, BEFORE)).astype(np.uint8)]
    while len(table[-1]) > (1 << (len(table) - 1)):
        t, s = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(t[:-s], t[s:]))
    inner = lcp[1:]
    for r in np.unique(inner[inner >= K])[::-1].tolist():
        grp = np.concatenate([[0], np.cumsum(inner < r)])
        live = np.zeros(grp[-1] + 1, bool)
        live[grp[1:][inner == r]] = True
        who = np.flatnonzero(live[grp])
        who = who[np.argsort(grp[who] * n + rank[who])]
        a, b = who[:-1], who[1:]
        ok = grp[a] == grp[b]
        a, b = a[ok], b[ok]
        lo, hi = rank[a], rank[b]  # the least LCP of the order of the bytes before, between the two
        span = hi - lo
        level = np.floor(np.log2(span)).astype(np.int64)
        f = np.empty(len(a), np.int64)
        for lev in np.unique(level).tolist():
            m = level == lev
            f[m] = np.minimum(table[lev][lo[m]], table[lev][hi[m] - (1 << lev)])
        f = np.minimum(f, np.minimum(llen[a], llen[b]))
        good = f >= LEAST - r
        for x in (a[good], b[good]):
            np.minimum.at(first, x, LEAST - r)
            np.maximum.at(last, x, f[good])
    return first, last


_FOUND = "th long, tb long, start long, stop long"


def _runs(joined: DataFrame, ranges: int) -> DataFrame:
    """(part, kind, th, tb, start, stop, block): front-coded sorted runs by bucket (kind 1), and spans that a batch settles by itself (kind 0)."""

    def send(right, rlen, left, llen, *row):
        enough = rlen + llen >= LEAST
        right, rlen, left, llen, th, tb, pos = (c[enough] for c in (right, rlen, left, llen, *row))
        if not len(th):
            return
        order = _order(np.concatenate([right, left, rlen[:, None].astype(np.uint8)], axis=1))
        right, rlen, left, llen, th, tb, pos = (c[order] for c in (right, rlen, left, llen, th, tb, pos))
        same = (right[1:] == right[:-1]).all(axis=1) & (left[1:] == left[:-1]).all(axis=1)
        first = np.concatenate([[True], ~same])
        many = ~first
        many[:-1] |= same
        spans = (th[many], tb[many], (pos - llen)[many], (pos + rlen)[many])
        right, rlen, left, llen = right[first], rlen[first], left[first], llen[first]
        th, tb, pos = th[first], tb[first], np.where(many[first], -1, pos[first])  # -1: settled, stands for others to find
        with np.errstate(over="ignore"):
            part = (X.mix(right[:, :K].astype(np.uint64) @ _WEIGHT) % X.U(ranges)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], part[by][1:] != part[by][:-1], [True]]))
        blocks, parts = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            w = by[a:b]
            parts.append(int(part[w[0]]))
            blocks.append(encode(right[w], rlen[w], left[w], llen[w], th[w], tb[w], pos[w]))
        n, m = len(spans[0]), len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(spans[0] % ranges).tolist(), *parts], pa.int64()), pa.array([0] * n + [1] * m, pa.int8()), *(pa.array([*x.tolist(), *[None] * m], pa.int64()) for x in spans), pa.array([None] * n + blocks, pa.binary())],
            names=["part", "kind", "th", "tb", "start", "stop", "block"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rb in batches:
            ths, tbs = rb.column(0).to_numpy(), rb.column(1).to_numpy()
            places = rb.column(3)
            for i, j, buf, off in X.pieces(rb, "text", RUN_BYTES):
                p = places.slice(i, j - i)
                count = np.array([len(x) for x in p], np.int64)
                d = np.repeat(np.arange(j - i), count)
                pos = p.flatten().to_numpy().astype(np.int64)
                inside = pos + K <= np.diff(off)[d]  # places of another text of the same half hash may lie beyond
                d, pos = d[inside], pos[inside]
                for s in range(0, len(pos), 50_000):
                    ds, ps = d[s : s + 50_000], pos[s : s + 50_000]
                    at = off[ds] + ps
                    rlen, llen = np.minimum(off[ds + 1] - at, LEAST), np.minimum(ps, BEFORE)
                    held.append((_gather(buf, at, rlen, LEAST, False), rlen, _gather(buf, at, llen, BEFORE, True), llen, ths[i + ds], tbs[i + ds], ps))
                    size += len(ds)
                    if size >= 50_000:
                        yield from send(*(np.concatenate(c) for c in zip(*held, strict=True)))
                        held, size = [], 0
        if held:
            yield from send(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return joined.select("th", "tb", "text", "places", "did").mapInArrow(run, f"part long, kind byte, {_FOUND}, block binary")


def _merged(runs: DataFrame, n: int) -> DataFrame:
    """(th, tb, start, stop): repeated byte ranges, from the merged suffix array of each bucket of the exchange."""
    names = ["th", "tb", "start", "stop"]

    def settle(blocks: list[bytes]):
        got = [decode(b) for b in blocks]
        order, lcps = merge([(g[6], g[0].tolist()) for g in got])
        base = np.cumsum([0, *(len(g[3]) for g in got)])
        at = np.array([base[r] + i for r, i in order], np.int64)
        rlen, llen, th, tb, pos, left = (np.concatenate([g[c] for g in got])[at] for c in (1, 2, 3, 4, 5, 7))
        lcp = np.array(lcps, np.int64)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(rlen[1:], rlen[:-1]))
        first, last = reach(lcp, rlen, left, llen)
        use = (first <= last) & (pos >= 0)
        return pa.RecordBatch.from_arrays([pa.array(th[use]), pa.array(tb[use]), pa.array((pos - last)[use].astype(np.int64)), pa.array((pos - first + LEAST)[use].astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for rb in batches:
            kind = rb.column(1).to_numpy()
            ready = rb.filter(pa.array(kind == 0))
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays([ready.column(c) for c in (2, 3, 4, 5)], names=names)
            sent = rb.filter(pa.array(kind == 1))
            for p, b in zip(sent.column(0).to_pylist(), sent.column(6).to_pylist(), strict=True):
                if p != now and blocks:
                    yield settle(blocks)
                    blocks = []
                now = p
                blocks.append(b)
        if blocks:
            yield settle(blocks)

    return runs.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, _FOUND)


def _union(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), stops[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(did, th, tb, text) of every row, and (th, ranges, each with the row's tb) with the repeated byte ranges of the rows that have any."""
    spark = docs.sparkSession
    rows = _keyed(docs, key, text)
    # an anchor of 32 bytes for about 77 bytes of text, which is a third of that in files
    n = tasks(spark, 1.25 * plan_bytes(docs))
    found = save(_repeated(_fingerprints(rows.where(F.octet_length("text") >= LEAST)), HOT, n), "anchors")
    n = tasks(spark, SUFFIX_BYTES * found.count())
    hot = found.where("th is null").select("fp")
    many = hot.count()
    found = found.where("th is not null")
    together = lambda part: rows.join(part.groupBy("th").agg(F.sort_array(F.collect_set("pos")).alias("places")), "th")
    if many:
        hot = save(hot, "hot")
        listed = F.broadcast(hot) if many <= HOT_LIST else hot
        ask = _windows(together(found.join(listed, "fp", "left_semi")))
        more = _repeated(ask, 1 << 62, n).where("th is not null").select("th", "tb", F.col("pos").cast("long").alias("start"), (F.col("pos") + LEAST).cast("long").alias("stop"))
        found = found.join(listed, "fp", "left_anti")
    ranges = _merged(_runs(together(found), RANGES * n), n)
    ranges = ranges.unionByName(more) if many else ranges
    # sets, for each copy of a repeated row finds the same places and ranges
    # one hash is the key here too, so that the texts are dealt out by it once; the other half is compared in `_own`
    return rows, ranges.groupBy("th").agg(F.collect_set(F.struct("tb", "start", "stop")).alias("ranges"))


def _own(ranges: str, tb: str) -> Column:
    """The ranges of a row itself, null if it has none."""
    mine = F.transform(F.filter(ranges, lambda x: x.tb == F.col(tb)), lambda x: F.struct(x.start.alias("start"), x.stop.alias("stop")))
    return F.when(F.size(mine) > 0, mine)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept_bytes) of every row: each byte covered by a string of LEAST bytes that also starts elsewhere goes.

    Texts are UTF-8 bytes; matches never cross texts and are judged on the input. Null or short texts lose nothing.
    A repeated row repeats all its strings. Rows of one id and different texts are told apart by their text.
    """
    rows, ranges = repeated(docs, key, text)
    joined = rows.join(ranges, "th", "left").select("did", "text", _own("ranges", "tb").alias("ranges"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, buf, off in X.pieces(rb, "text"):
                out = []
                said = buf.tobytes()
                for d, found in enumerate(rb.column(2).slice(i, j - i)):
                    a, b = int(off[d]), int(off[d + 1])
                    cut = []
                    if found.is_valid:
                        flat = found.values
                        cut = _union(flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False))
                    left, at = [], a
                    for s, e in cut:
                        left.append(said[at : a + s])
                        at = a + e
                    rest = b"".join([*left, said[at:b]])
                    out.append((b - a, b - a - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), [{"start": s, "stop": e} for s, e in cut], rest))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3]), pa.array(cols[4], span), pa.array(cols[5], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_bytes"])

    return joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept_bytes binary")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the repeated bytes cut out of `text`; bytes of a character cut in two are dropped, and so is a row of which nothing is left."""
    own = docs.columns
    _, ranges = repeated(docs, key, text)
    th, tb, found_in = fresh(docs, "th", "tb", "ranges")
    a, b = _row(key, text)
    joined = docs.withColumns({th: a, tb: b}).join(ranges.select(F.col("th").alias(th), F.col("ranges").alias(found_in)), th, "left").select(*own, _own(found_in, tb).alias(found_in))
    where = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts: list[str | None] = []
            for said, found in zip(rb.column(where), rb.column(len(own)), strict=True):
                if not found.is_valid:
                    texts.append(said.as_py())
                    continue
                raw, flat = said.as_py().encode(), found.values
                left, at = [], 0
                for s, e in _union(flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)):
                    left.append(raw[at:s].decode("utf-8", "ignore"))
                    at = e
                rest = "".join([*left, raw[at:].decode("utf-8", "ignore")])
                texts.append(rest if rest.strip() else None)
            gone = pa.array([t is None and f.is_valid for t, f in zip(texts, rb.column(len(own)), strict=True)], pa.bool_())
            cols = [pa.array(texts, pa.string()) if c == where else rb.column(c) for c in range(len(own))]
            yield pa.RecordBatch.from_arrays(cols, names=own).filter(pc.invert(gone))

    return joined.mapInArrow(run, docs.schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)),
t AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
o AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM t),
i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM o),
s AS (SELECT doc_id, g, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, g),
x AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS r, count(*) AS c, max(b) AS e, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS rest FROM x JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(rest, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
