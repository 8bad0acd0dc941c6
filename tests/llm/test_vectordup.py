import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import vectordup as D

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(vec_id, n_links, component_id, kept) of rows (id, vector) by all pairs."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for dim in {len(rows[k][1]) for k in good}:
        at = [k for k in good if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in at], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in np.argwhere(np.triu(x @ x.T >= 0.95, 1)).tolist():
            n[at[i]] += 1
            n[at[j]] += 1
            root[find(at[i])] = find(at[j])
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(least.get(find(k), key), key)
    out = [(key, n[k], least.get(find(k))) for k, (key, _) in enumerate(rows)]
    return sorted(((*r, r[0] == r[2] or r[2] is None) for r in out), key=repr)


def got(spark, rows, **more):
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in D.groups(df, **more).collect()), key=repr)


def near(rng, base, cosines):
    """Vectors of these cosines with `base`."""
    base = np.asarray(base, float) / np.linalg.norm(base)
    out = []
    for c in cosines:
        side = rng.standard_normal(len(base))
        side -= side @ base * base
        out.append((c * base + math.sqrt(1 - c * c) * side / np.linalg.norm(side)).tolist())
    return out


def test_links_of_all_strengths(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(64).tolist()) for k in range(300)]
    for k in range(60):
        rows += [(1000 + 10 * k + j, v) for j, v in enumerate(near(rng, rows[k][1], rng.uniform(0.93, 0.9999, 1 + k % 8)))]
    rows += [(9000 + k, v) for k, v in enumerate([rows[5][1]] * 4)]  # exact copies
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    rows += [(9100 + k, (5 * (math.cos(0.3 * k) * a + math.sin(0.3 * k) * b)).tolist()) for k in range(12)]  # a chain
    assert got(spark, rows) == brute(rows)


def test_hard_vectors(spark):
    x = [0.5, -1.0, 2.0]
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [float("inf"), 1.0, 1.0]), (7, x), (7, x), (8, [1.0, -2.0, 4.0]), (None, x), (None, [9.0, 1.0, 1.0]),
        (None, [9.0, 1.0, 1.01]), (9, [3e38, 3e38, 1e38]), (10, [1e-40, 1e-40, 0.34e-40]), (11, [7.0]), (12, [3.0]), (13, [-3.0]), (14, [0.5, -1.0, 2.0, 0.0]), (15, [-0.5, 1.0, -2.0]), (1, None),
    ]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("spread", [(0.988, 1.0), (0.97, 1.0)])
def test_large_clusters(spark, monkeypatch, spread):
    """A core that is linked without comparison, and what lies outside it in blocks."""
    monkeypatch.setattr(D, "BLOCK", 60)
    rng = np.random.default_rng(2)
    rows = [(k, v) for k, v in enumerate(near(rng, rng.standard_normal(32), rng.uniform(*spread, 250)))]
    rows += [(1000 + k, v) for k, v in enumerate(near(rng, rows[0][1], rng.uniform(0.94, 0.97, 40)))] + rows[:3] * 5
    rows += [(2000 + k, rng.standard_normal(32).tolist()) for k in range(100)]
    assert got(spark, rows) == brute(rows)


def test_one_of_each_component_stays(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(16).tolist()
    rows = [(2, x, 1), (1, near(rng, x, [0.99])[0], 1), (1, near(rng, x, [0.99])[0], 2), (None, x, 3), (5, rng.standard_normal(16).tolist(), 4), (6, None, 5), (None, None, 6)]
    out = D.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] for r in out), key=str) == [1, 5, 6, None]


def test_no_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.groups(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA).withColumns({c: F.lit("own") for c in ("ka", "KB", "least", "n", "v", "root", "skey", "kept")})
    r = D.groups(one).first()
    assert r["ka"] == r["least"] == r["n"] == r["root"] == "own" and r["kept"] is True and r["n_links"] == 0
    with pytest.raises(ValueError):
        D.groups(empty.withColumnRenamed("vec_id", "kept"), key="kept")


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    a = D.unit(rng.standard_normal((1, 64)))
    for cosine in (0.0, 0.5, 0.95):
        b = D.unit(np.array(near(rng, a[0], [cosine])))
        made = []
        for k in range(400):
            turn = D.rotation(64, k)
            signs, factors = D.coded(a.astype(np.float32) @ turn)
            e = float(D.estimates(signs, factors, b.astype(np.float32) @ turn)[0, 0])
            sure, likely = D.bounds(factors, 64)
            assert abs(e - cosine) <= likely[0] <= sure[0] + 1e-9
            assert abs(e - cosine) <= sure[0] * math.sqrt(1 - cosine**2) + 1e-5
            made.append(e)
        assert abs(np.mean(made) - cosine) < 4 * np.std(made) / math.sqrt(len(made)) + 1e-6


def test_bounds_spare_exact_products():
    rng = np.random.default_rng(5)
    tight = D.unit(np.array(near(rng, rng.standard_normal(64), np.full(300, 0.99))))
    link, again = D.linked(tight, tight)
    assert link.all() and again < 0.02 * link.size
    loose = D.unit(rng.standard_normal((300, 64)))
    link, again = D.linked(loose, loose)
    assert (link == (loose @ loose.T >= 0.95)).all() and again < 0.05 * link.size


def test_regions_beyond_the_limit(monkeypatch):
    monkeypatch.setattr(D, "REGION", 40)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, 32, dtype=np.uint8)
    rows = np.tile(base, (300, 1)) ^ np.packbits(rng.random((300, 256)) < 0.02, axis=1)
    rows = rows[np.lexsort(rows.T[::-1])]
    found = D._region(D._words(rows), rows, D.most_apart(256))
    root = list(range(300))
    for x, y in found:
        a, b = sorted((root[x], root[y]))
        root = [a if r == b else r for r in root]
    assert len(set(root)) == 1 and len(found) < 300 * 12


@pytest.mark.parametrize(("n", "most"), [(10**4, 45), (10**6, 80), (10**9, 400)])
def test_bands_grow_slowly(n, most):
    bits, count = D.bands(n)
    assert count <= most and n / 2**bits <= D.DENSE
    assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** count <= D.MISS


def _joined(n, links):
    """The component of each of `n` places."""
    root = list(range(n))
    for x, y in links:
        a, b = sorted((root[x], root[y]))
        root = [a if r == b else r for r in root]
    return root


def _loose(rng, n):
    """Vectors around two centres, of which many are near few others, and copies of their sides in a chain."""
    out = []
    for k in range(2):
        base = rng.standard_normal(32)
        out += near(rng, base, rng.uniform(0.9, 0.999, n))
    return out


def test_a_crowded_region_loses_no_pair(monkeypatch):
    """Rows that differ early in the region's order and lie far from each other in it."""
    monkeypatch.setattr(D, "REGION", 40)
    rng = np.random.default_rng(7)
    most = D.most_apart(256)
    for share in (0.12, 0.13, 0.14):
        base = rng.integers(0, 256, 32, dtype=np.uint8)
        rows = np.tile(base, (300, 1)) ^ np.packbits(rng.random((300, 256)) < share, axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        code = D._words(rows)
        pairs = np.argwhere(np.bitwise_count(code[:, None] ^ code[None, :]).sum(axis=2) <= most).tolist()
        assert _joined(300, D._region(code, rows, most)) == _joined(300, pairs)


@pytest.mark.parametrize("region", [4, 50, 8192])
def test_regions_of_any_size_and_of_several_tasks_lose_no_candidate(spark, monkeypatch, region):
    monkeypatch.setattr(D, "REGION", region)
    rng = np.random.default_rng(8)
    x = _loose(rng, 150)
    bits, count = D.bands(len(x))
    total = max(D.LEAST_BITS, bits * count)
    signs = D.codes(D.unit(x), total)
    apart = (signs[:, None] != signs[None, :]).sum(axis=2)
    shared = np.zeros(apart.shape, bool)
    for band in range(count):
        own = np.roll(signs, -band * bits, axis=1)[:, :bits]
        shared |= (own[:, None] == own[None, :]).all(axis=2)
    want = np.argwhere(shared & (apart <= D.most_apart(total))).tolist()
    found = D.candidates(spark.createDataFrame(list(enumerate(x)), "skey long, v array<double>"), len(x)).collect()
    assert _joined(len(x), [(r["a"], r["b"]) for r in found]) == _joined(len(x), want)


def test_crowded_regions_link_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "REGION", 8)
    rows = list(enumerate(_loose(np.random.default_rng(9), 120)))
    assert got(spark, rows) == brute(rows)
