"""Vectorised tokenising and hashing of Arrow string columns: whole batches of texts as one byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = U(0xC2B2AE3D27D4EB4F)
#: A random value for each byte, so that sums of powers don't cancel for short words.
_LETTER = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
#: Powers that a worker keeps for the next batch; those of longer texts go with them.
KEPT_POWERS = 1 << 22
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters of either case and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS[kind]
    while len(have) < n:
        with np.errstate(over="ignore"):  # arithmetic modulo 2^64
            have = np.concatenate([have, have * (have[-1] * base)])
    _POWERS[kind] = have[:KEPT_POWERS]
    return have


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    c = batch.column(batch.schema.get_field_index(name))
    c = c.cast(pa.large_binary())
    if c.null_count:
        c = c.fill_null(b"")
    off = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    data = c.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, name: str, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows in runs of about `most` bytes of text: first row, end row, bytes, offsets. A longer text is a run of its own."""
    buf, off = column(batch, name)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes of `kind`), and for each text the index of its first word (n + 1)."""
    n = len(buf)
    mark = kind[buf]
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    edge = off[(off > 0) & (off < n)]
    first[edge] = mark[edge]
    last[edge - 1] = mark[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LETTER[buf] * _powers("up", _BASE, len(buf))[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers("down", _INVERSE, len(buf))[starts] + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, for each start; those that cross a text's end are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _SHINGLE + hashes[j : j + n]
    return mix(out + U(k))


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingles as hashes; fewer words: the whole sequence as one; none: empty."""
    starts, ends, at = words(buf, off, SPACED)
    h = spans_hash(LOWER[buf], starts, ends)
    g = grams(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(grams(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
