import random

import pytest

from tidewire.llm import neardup as D


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(docs):
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in D.groups(docs).collect()), key=str)


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.random()}" if r.random() < share else w for w in text.split())


def test_copies_chains_and_strangers(spark, make, prose):
    rows = [(i, prose(i)) for i in range(40)]
    rows += [(100 + i, edited(prose(i % 10), 0.02, i)) for i in range(60)]
    t = prose(50, 200).split()
    rows += [(200 + k, " ".join(t[4 * k :] + [f"end{k}"])) for k in range(12)]  # a chain whose ends aren't alike
    rows += [(300, " A  b\tc"), (301, "a B\nc"), (302, "a b c d e"), (303, "A b c d E")]
    assert got(make(rows)) == brute(rows)


def test_hard_texts(spark, make, hard):
    assert got(make(hard)) == brute(hard)


def test_many_copies_of_a_row(spark, make, prose):
    rows = [(1, prose(1))] * 300 + [(2, edited(prose(1), 0.01, 1))] * 200 + [(3, prose(2))] * 100
    assert got(make(rows)) == brute_by_text(rows)
    assert D.deduplicated(make(rows)).count() == 2


def brute_by_text(rows):
    """Brute force over the distinct rows, for each of the rows."""
    one = sorted(set(rows))
    of = dict(zip(one, [(i, n, c) for i, n, c in brute(one)], strict=True)) if len({r[0] for r in one}) == len(one) else None
    return sorted((of[r] for r in rows), key=str)


def test_kept_is_one_of_each_group(spark, make, prose):
    rows = [(i, edited(prose(i // 5), 0.01, i)) for i in range(50)]
    kept = D.deduplicated(make(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_kept_once_of_repeated_rows_and_null_ids(spark, make, prose):
    rows = [(1, prose(1))] * 3 + [(1, edited(prose(1), 0.01, 1)), (2, prose(1)), (1, prose(9))]
    rows += [(None, prose(2))] * 2 + [(None, edited(prose(2), 0.01, 2)), (None, prose(3)), (4, prose(3)), (5, ""), (5, ""), (6, ""), (None, None), (None, None)]
    rows = [(*r, f"l{k}", None, k) for k, r in enumerate(rows)]
    out = D.deduplicated(make(rows)).collect()
    assert sorted(((r["doc_id"], len(shingles(r["text"])) > 0) for r in out), key=str) == sorted([(1, True), (1, True), (None, True), (4, True), (5, False), (6, False), (None, False)], key=str)
    assert all(tuple(r) in rows for r in out)


def test_blocks_of_a_large_cluster(spark, make, prose, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 8)
    rows = [(i, edited(prose(1), 0.02, i)) for i in range(60)] + [(100 + i, edited(prose(2, 120), 0.045, i)) for i in range(60)]
    assert got(make(rows)) == brute(rows)


def templated(prose, n, seed=0):
    """Pages of one template, alike in about half of their shingles but no links, with a near copy of every tenth."""
    stem, rows = prose(7, 60), []
    for i in range(n):
        t = f"{stem} {prose(10_000 + seed + i, 28)}"
        rows.append((i, t))
        if i % 10 == 0:
            rows.append((n + i, edited(t, 0.01, i)))
    return rows


def test_template_copies_each_text_a_bounded_number_of_times(spark, make, prose, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    monkeypatch.setattr(D, "PAIRS", 4)
    read, whole = [], D.verify
    monkeypatch.setattr(D, "verify", lambda members, size: read.append(members.count()) or whole(members, size))
    rows = templated(prose, 1500)
    assert got(make(rows)) == brute(rows)
    _, trees = D.fine(len(rows) // 16)
    assert trees < 100 and D.fine(100 * len(rows) // 16)[1] < 10 * trees
    assert len(read) > 2 and sum(read) < trees * len(rows)  # pairs of 104 blocks would be 104 copies


def test_recall_in_dense_regions(spark):
    """The real candidates on 50,000 sketches of 25,000 pairs: the largest region is far beyond 8 * REGION, and none is linked but the pairs."""
    import numpy as np

    r = np.random.default_rng(8)
    n, common = 25_000, r.integers(0, 1 << 32, D.VALUES, dtype=np.uint32)
    one = np.where(r.random((n, D.VALUES)) < 0.22, common, r.integers(0, 1 << 32, (n, D.VALUES), dtype=np.uint32))
    one[:, :8] = np.where(r.random((n, 8)) < 0.9, common[:8], one[:, :8])  # the first orders begin alike
    other = np.where(r.random((n, D.VALUES)) < 0.76, one, r.integers(0, 1 << 32, (n, D.VALUES), dtype=np.uint32))
    _, size = np.unique(one[:, : D.DEPTH], axis=0, return_counts=True)
    assert size.max() * 2 > 8 * D.REGION
    import pandas as pd

    sig = np.concatenate([one, other])
    table = spark.createDataFrame(pd.DataFrame({"skey": np.arange(2 * n), "sig": [x.tobytes() for x in sig]}))
    link = D.candidates(table).toPandas()
    root = np.arange(2 * n)
    for _ in range(40):
        low = np.minimum(root[link.a], root[link.b])
        np.minimum.at(root, link.a, low)
        np.minimum.at(root, link.b, low)
    close = (one == other).sum(axis=1) >= D.LEAST_COMMON
    assert (root[:n] == root[n:])[close].mean() >= 0.999


def test_dense_region_splits(monkeypatch):
    import numpy as np

    monkeypatch.setattr(D, "REGION", 16)
    r = np.random.default_rng(1)
    base = r.integers(0, 256, (3, D.VALUES), dtype=np.uint8)
    rows = np.repeat(base, 40, axis=0)
    rows[:, 20:26] = r.integers(0, 256, (120, 6), dtype=np.uint8)
    rows = rows[np.lexsort(rows.T[::-1])]
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in D._region(rows, D.DEPTH):
        root[find(b)] = find(a)
    assert len({find(i) for i in range(120)}) == 3


def test_empty_and_clashing(spark, make, prose):
    assert D.groups(make([])).count() == 0
    docs = spark.createDataFrame([(1, prose(1), 5), (2, prose(1), 6)], "doc_id long, text string, _row int")
    assert [tuple(r)[::2] for r in D.deduplicated(docs).collect()] == [(1, 5)]


@pytest.mark.parametrize("share", [0.0, 0.015, 0.03])
def test_recall_near_the_threshold(spark, make, prose, share):
    rows = [x for i in range(80) for x in ((2 * i, prose(i, 150)), (2 * i + 1, edited(prose(i, 150), share, i)))]
    assert got(make(rows)) == brute(rows)
