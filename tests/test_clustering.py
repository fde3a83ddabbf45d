"""Batched K-Means against a plain recomputation; PCA axes on exact moments."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from storelens.operators import clustering as L
from storelens.operators import segmentation as G

COLS = ["a", "b"]


def table(spark, points, partitions=3):
    return spark.createDataFrame([(f"c{i}", float(x), float(y)) for i, (x, y) in enumerate(points)], "cliente_id string, a double, b double").repartition(partitions)


def half_up(x):
    return math.floor(x + Fraction(1, 2))


def away_from_zero(x):
    return half_up(x) if x >= 0 else -half_up(-x)


def brute(points, k, seed, restarts, max_steps=100):
    rows = {f"c{i}": [away_from_zero(Fraction(str(x)) * 10**4) for x in p] for i, p in enumerate(points)}
    best = None
    for r in range(restarts):
        start = sorted(rows, key=lambda c: L.start_key(c, seed, r))[:k]
        cs = [list(rows[c]) for c in start]
        away = lambda v: [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cs]
        for _ in range(max_steps):
            mine = {n: away(v).index(min(away(v))) for n, v in rows.items()}
            new = []
            for j, c in enumerate(cs):
                own = [rows[n] for n in rows if mine[n] == j]
                new.append([100 * half_up(Fraction(sum(x), 100 * len(own))) for x in zip(*own, strict=True)] if own else c)
            shift = sum((a - b) ** 2 for x, y in zip(new, cs, strict=True) for a, b in zip(x, y, strict=True))
            cs = new
            if shift <= 10_000:
                break
        cost = sum(min(away(v)) for v in rows.values())
        if best is None or cost < best[0]:
            best = (cost, r, {n: away(v).index(min(away(v))) for n, v in rows.items()})
    return best


def points(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(n, 2)) + rng.integers(0, 4, (n, 1)) * 1.5, 5).tolist()


@pytest.mark.parametrize("partitions, chunk", [(1, 4096), (5, 7)])
def test_equals_plain_recomputation(spark, monkeypatch, partitions, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    pts = points(160)
    labelled, kept = L.lloyd_segments(table(spark, pts, partitions), k=4, seed=7, restarts=6, cols=COLS)
    cost, restart, labels = brute(pts, 4, 7, 6)
    assert {r.cliente_id: r.cluster_raw for r in labelled.collect()} == labels
    assert kept.restart == restart and math.isclose(kept.cost, cost / 10**8)


def test_few_clients_ties_and_none(spark):
    same = [[1.0, 2.0]] * 6
    labelled, kept = L.lloyd_segments(table(spark, same), k=3, restarts=2, cols=COLS)
    assert {r.cluster_raw for r in labelled.collect()} == {0} and kept.cost == 0 and kept.restart == 0
    labelled, kept = L.lloyd_segments(table(spark, [[0.0, 0.0], [5.0, 5.0]]), k=4, restarts=3, cols=COLS)
    assert sorted(r.cluster_raw for r in labelled.collect()) == [0, 1] and kept.cost == 0
    labelled, kept = L.lloyd_segments(table(spark, [[0.0, 0.0]]).limit(0), k=4, cols=COLS)
    assert labelled.collect() == [] and kept.steps == 0 and labelled.columns == ["cliente_id", "cluster_raw"]


def test_scans_do_not_grow_with_restarts(spark, monkeypatch):
    scans = []
    sums = L.cluster_sums
    monkeypatch.setattr(L, "cluster_sums", lambda *a: scans.append(len(a[1])) or sums(*a))
    _, kept = L.lloyd_segments(table(spark, points(120)), k=3, restarts=9, cols=COLS)
    assert len(scans) == kept.steps + 1 and scans[0] == scans[-1] == 9
    assert all(a >= b for a, b in zip(scans[:-1], scans[1:-1], strict=False))


def test_principal_axes_are_the_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    x -= x.mean(0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "cliente_id long, a double, b double, c double, d double")
    m = G.cross_moments(df, list("abcd"))
    assert np.allclose(m, np.round(x, 6).T @ np.round(x, 6), atol=1e-6)
    _, v = np.linalg.eigh(m)
    for axis, want in zip(G.principal_axes(m, 2), (v[:, 3], v[:, 2]), strict=True):
        assert abs(abs(axis @ want) - 1) < 1e-9 and axis[abs(axis).argmax()] > 0
    assert (G.principal_axes(np.zeros((3, 3)), 2)[0] == 0).all()
    empty = G.pca_2d(df.filter(F.lit(False)), list("abcd"))
    assert empty.collect() == [] and empty.columns == ["cliente_id", "pca_x", "pca_y"]
