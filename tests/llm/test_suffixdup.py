import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import suffixdup as D


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + D.LEAST] for b in raw for p in range(len(b) - D.LEAST + 1))
    out = []
    for b in raw:
        hit = bytearray(len(b))
        for p in range(len(b) - D.LEAST + 1):
            if seen[b[p : p + D.LEAST]] > 1:
                hit[p : p + D.LEAST] = b"\1" * D.LEAST
        rest = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((len(b), sum(hit), spans, hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, make, rows):
    got = sorted(tuple(r[:5]) for r in D.removed(make(rows)).select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) if all(r[0] is not None for r in rows) else None
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True)]
    if got is not None:
        assert got == sorted(want)
    return want


def test_repeats_across_and_within(spark, make, prose):
    a, b = prose(1, 100), prose(2, 100)
    rows = [(1, a), (2, b + a[100:350] + b[:150]), (3, a[:199]), (4, a[:200] + "é"), (5, "é" + a[:200]), (6, b[5:300]), (7, "ab" * 150), (8, "x" * 450), (9, prose(3))]
    check(spark, make, rows)


def test_pieces_of_all_lengths(spark, make, prose):
    r = random.Random(5)
    base = [prose(k, 150) for k in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            t = r.choice(base)
            s = r.randrange(len(t) - 300)
            parts.append(t[s : s + r.randint(150, 290)])
        rows.append((i, r.choice(["", " ", "ü"]).join(parts)))
    check(spark, make, rows)


def test_hard_texts(spark, make, hard):
    rows = [(i, t) for i, (_, t) in enumerate(hard) if t is None or len(t) < 60_000]
    check(spark, make, [*rows, (100, hard[7][1])])
    assert D.removed(make(hard)).count() == len(hard)


def test_repeated_rows_and_null_ids(spark, make, prose):
    t = prose(4)
    out = D.removed(make([(1, t), (1, t), (None, prose(5)), (None, prose(5))])).collect()
    assert [r["n_removed"] for r in out] == [len(r["kept_bytes"]) * 0 + r["n_bytes"] for r in out]


def test_repeated_rows_stay_in_proportion(spark, make, prose):
    """Every copy finds the same places: the ranges of a row don't grow with its copies, and the rows aren't multiplied."""
    t, found = prose(4, 120), {}
    for n in (50, 400):
        rows, ranges = D.repeated(make([(1, t)] * n + [(2, prose(5))]))
        found[n] = sum(len(r["ranges"]) for r in ranges.collect())
        out = D.removed(make([(1, t)] * n + [(2, prose(5))])).collect()
        assert len(out) == n + 1 and all(r["n_removed"] == (r["n_bytes"] if r["id"] == 1 else 0) for r in out)
    assert found[400] <= found[50] <= len(t)


def test_rows_of_the_same_half_hash_are_told_apart(spark, make, prose, monkeypatch):
    whole = D._row
    monkeypatch.setattr(D, "_row", lambda key, text: (F.lit(7).cast("long").alias("th"), whole(key, text)[1]))
    a, b = prose(1, 100), prose(2, 100)
    check(spark, make, [(1, a), (2, b + a[100:350] + b[:150]), (3, prose(3, 200)), (4, prose(4, 60)), (5, prose(5, 300)), (6, "x" + b[5:300])])
    monkeypatch.setattr(D, "HOT", 1)
    check(spark, make, [(1, a), (2, b + a[100:350] + b[:150]), (3, prose(3, 200)), (4, a[:260]), (5, prose(5, 300))])


def test_stretches_choose_the_same_anchors(monkeypatch):
    r = np.random.default_rng(3)
    buf = r.integers(97, 101, 30_000, dtype=np.uint8)
    buf[9_000:12_000] = 97  # ties
    want = D.anchors(buf, np.array([0, len(buf)]))
    for stretch in (400, 1000, 4096, 29_999):
        monkeypatch.setattr(D, "STRETCH", stretch)
        got = D.anchors(buf, np.array([0, len(buf)]))
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_empty_table_and_clashing_columns(spark, make, prose):
    assert D.removed(make([])).count() == 0
    docs = spark.createDataFrame([(1, prose(1), "a", 2), (2, prose(1) + " tail of the second text", "b", 3), (3, "short", None, None)], "doc_id long, text string, th string, ranges int")
    out = {r["doc_id"]: r for r in D.cleaned(docs).collect()}
    assert sorted(out) == [2, 3] and out[2]["th"] == "b" and out[2]["ranges"] == 3
    assert out[2]["text"] == " tail of the second text" and out[3]["text"] == "short"


def test_cut_characters_are_dropped(spark, make):
    core = "é" * 120
    out = D.cleaned(make([(1, "a" + core + "b"), (2, "c" + core + "d")])).collect()
    assert sorted(r["text"] for r in out) == ["ab", "cd"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=0, max_size=6), max_size=12), max_size=6))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs if r]
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    order, lcps = D.merge([(r, [0, *(lcp(a, b) for a, b in zip(r, r[1:]))]) for r in runs])
    said = [runs[r][i] for r, i in order]
    assert said == sorted(x for r in runs for x in r)
    assert lcps[1:] == [lcp(a, b) for a, b in zip(said, said[1:])]


def test_front_coding_round_trip():
    r = np.random.default_rng(1)
    right = np.full((50, D.LEAST), 0xFF, np.uint8)
    rlen = r.integers(60, D.LEAST + 1, 50)
    left = np.full((50, D.BEFORE), 0xFF, np.uint8)
    llen = r.integers(0, D.BEFORE + 1, 50)
    for i in range(50):
        right[i, : rlen[i]] = r.integers(97, 99, rlen[i])
        left[i, : llen[i]] = r.integers(97, 99, llen[i])
    by = D._order(right)
    right, rlen, left, llen = right[by], rlen[by], left[by], llen[by]
    lcp, r2, l2, th, tb, pos, said, left2 = D.decode(D.encode(right, rlen, left, llen, np.arange(50), np.arange(50) * 7, np.arange(50)))
    assert said == [bytes(x[:n]) for x, n in zip(right, rlen, strict=True)]
    assert (left2 == left).all() and (r2 == rlen).all() and (l2 == llen).all() and (pos == np.arange(50)).all() and (th == pos).all() and (tb == 7 * pos).all()


@pytest.mark.parametrize("seed", range(8))
def test_reach_is_brute_force(seed):
    r = random.Random(seed)
    left_of = [bytes(r.choice(b"ab") for _ in range(D.BEFORE)) for _ in range(3)]
    rows = []
    for _ in range(40):
        left = bytearray(r.choice(left_of))
        if r.random() < 0.7:
            left[r.randrange(D.BEFORE)] = 99
        right = bytearray(b"r" * D.LEAST)
        if r.random() < 0.8:
            right[r.randrange(D.K, D.LEAST)] = r.choice(b"xyz")
        rows.append((bytes(right), bytes(left[: r.choice([D.BEFORE, 20, 100])])))
    rows.sort()
    right = np.array([list(x) for x, _ in rows], np.uint8)
    llen = np.array([len(y) for _, y in rows])
    left = np.array([list(y) + [255] * (D.BEFORE - len(y)) for _, y in rows], np.uint8)
    rlen = np.full(len(rows), D.LEAST)
    lcp = np.concatenate([[0], D._common(right[1:], right[:-1], rlen[1:])])
    first, last = D.reach(lcp, rlen, left, llen)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for i, (ri, li) in enumerate(rows):
        ds = set()
        for j, (rj, lj) in enumerate(rows):
            if i != j:
                ds |= set(range(D.LEAST - common(ri, rj), common(li, lj) + 1))
        assert (first[i], last[i]) == ((min(ds), max(ds)) if ds else (D.LEAST, -1))


def test_hot_passages(spark, make, prose, monkeypatch):
    monkeypatch.setattr(D, "HOT", 5)
    line = prose(99, 45)
    assert 200 < len(line) < 330
    rows = [(i, prose(10 + i, 30 + i) + line + prose(90 + i, 25)) for i in range(12)] + [(50, prose(70)), (51, prose(70) + "x"), (52, line[:210] + "é"), (53, "ab" * 150 + line[60:]), (54, None)]
    check(spark, make, rows)
    monkeypatch.setattr(D, "HOT_LIST", 0)
    check(spark, make, rows)
