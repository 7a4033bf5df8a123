"""Clusters and whitening against plain definitions."""

import hashlib
import math

import numpy as np
import pytest

from dishlens.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, cluster int, x string, missing int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x", 1) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(9, 64)) * 2
    return [(i, [float(np.float32(c)) for c in middles[i % 9] + rng.normal(size=64) * 0.7]) for i in range(900)]


ODD = [
    (None, [0.5] * 64), (7, [0.25] * 64), (7, [0.25] * 64), (1000, None), (1001, [1.0] * 63), (1002, [float("nan")] * 64),
    (1003, [float("inf")] + [0.0] * 63), (1004, [None] + [0.0] * 63), (1005, []), (1006, [-0.1] * 64), (1007, [0.5] * 64),
]


def usable(v, width=64):
    return v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)


def plain_clusters(rows, k=8, rounds=10, seed=3, width=64):
    kept = [(i, [math.floor(1024 * c) for c in np.array(v, np.float32).astype(float)]) for i, v in rows if usable(v, width)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~"
    means = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(means)), key=lambda j: (far(x, means[j]), j))
    for _ in range(rounds):
        groups = [[] for _ in means]
        for _, x in kept:
            groups[nearest(x)].append(x)
        means = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else m for g, m in zip(groups, means, strict=True)]
    out = [(i, nearest(x), x) for i, x in kept]
    away = [far(x, means[c]) for _, c, x in out]
    inertia = [sum(d for d, (_, c, _) in zip(away, out, strict=True) if c == j) for j in range(len(means))]
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, inertia[c], sum(away), name[c]) for (i, c, _), d in zip(out, away, strict=True)), key=repr)


def plainly(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_clusters(spark, blobs):
    rows = blobs[:300] + ODD
    assert plainly(centroids.clustered(vectors_of(spark, rows).repartition(3))) == plain_clusters(rows)


def test_tighter_drift_scans_less_and_changes_nothing(spark, blobs):
    df, tight, full = vectors_of(spark, blobs).repartition(2), [], []
    assert plainly(centroids.clustered(df, scanned=tight)) == plainly(centroids.clustered(df, tight=False, scanned=full))
    assert tight[0] == full[0] == len(blobs) and sum(tight) < sum(full) < 11 * len(blobs)


def test_clusters_of_few_and_tied_vectors(spark):
    few = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])]
    again = [(i, [0.5, 0.5]) for i in range(30)]
    wide = [(1, [1e30, -1e30]), (2, [0.0, 0.0])]
    for rows in (few, again):
        assert plainly(centroids.clustered(vectors_of(spark, rows), width=2)) == plain_clusters(rows, width=2)
    assert [r[2] for r in plainly(centroids.clustered(vectors_of(spark, wide), width=2))] == [0, 0]
    assert centroids.clustered(vectors_of(spark, [])).collect() == []
    assert centroids.clustered(vectors_of(spark, [(1, None)])).collect() == []


def test_bounds_hold_for_any_point_of_the_sphere():
    rng = np.random.default_rng(2)
    less = 0
    for _ in range(300):
        n = int(rng.integers(2, 6))
        c, p, q = rng.normal(size=(3, n)) * rng.uniform(0.1, 5, (3, 1))
        r = float(rng.uniform(0, 3))
        bound = centroids.loosened(c, r, p, q)
        way = rng.normal(size=(400, n))
        x = c + r * way / np.sqrt((way**2).sum(1))[:, None] * rng.uniform(0, 1, (400, 1)) ** (1 / n)
        gain = np.sqrt(((x - p) ** 2).sum(1)) - np.sqrt(((x - q) ** 2).sum(1))
        assert gain.max() <= bound + 1e-9
        less += bound < 0.9 * np.sqrt(((p - q) ** 2).sum())
    assert less > 100


def fit_of(rows, width=64):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if usable(v, width)]
    return kept, np.array(sorted({tuple(x) for _, x in kept}), object)


def check_whitened(df, rows, width=64, count=16):
    got = df.collect()
    kept, fit = fit_of(rows, width)
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(int(v) * n - s) / n for v, s in zip(x, sums, strict=True)] for x in fit])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    values, turned = values[::-1], turned[:, ::-1]
    assert len(got) == count * len(kept)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, x in kept:
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        mine = by[i, deviation]
        assert sorted(mine) == list(range(1, count + 1))
        away = np.array([float(n * v - s) / n for v, s in zip(x, sums, strict=True)])
        for c in range(count):
            want = float(away @ turned[:, c]) / math.sqrt(values[c])
            r = mine[c + 1][0]
            if abs(want) > 1e-3:
                signs.setdefault(c, math.copysign(1, want * r.whitened))
            assert r.whitened == pytest.approx(signs.get(c, 1) * want, abs=1e-6)
            assert r.n == n and r.explained == pytest.approx(values[c] / values.sum(), rel=1e-8)
            assert 0 <= r.identity_error < 1e-9


def test_whitening(spark, blobs):
    rows = blobs[:200] + ODD
    check_whitened(whitening.whitened(vectors_of(spark, rows).repartition(3)), rows)


def test_whitening_of_uneven_and_flat_data(spark):
    rng = np.random.default_rng(1)
    scale = np.array([1e4, 1.0, 300.0, 20.0, 5.0])
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=5) * scale]) for k in range(150)]
    check_whitened(whitening.whitened(vectors_of(spark, rows)), rows, 5, 5)
    flat = [(k, [float(a), float(a * 2), 3.0, float(b)]) for k, (a, b) in enumerate(rng.integers(0, 50, (80, 2)).tolist())]
    check_whitened(whitening.whitened(vectors_of(spark, flat)), flat, 4, 2)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(9)], [(1, [])]):
        assert whitening.whitened(vectors_of(spark, rows)).collect() == []


def test_exact_deviations_beyond_a_long():
    mean = whitening.Mean(10**9, [10**15, 0])
    x = np.array([[1_000_000, 0], [1_000_007, 3]])
    assert mean.deviations(x) == [0, None]
    assert whitening.Mean(3, [3_000_001, 5]).deviations(x) == [1 + 25, (3 * 1_000_007 - 3_000_001) ** 2 + 16]
