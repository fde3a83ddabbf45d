"""Invariants of the ML path (no SQL oracle exists for K-Means / PCA)."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from storelens.operators import masters as M
from storelens.operators import segmentation as G


@pytest.fixture(scope="module")
def scaled(model_mid):
    m = model_mid
    master = M.client_master(m.clients, m.sales, m.products, m.visits, m.potential, m.horizon)
    return G.standardize(G.client_features(master)).cache()


def matrix(df):
    return np.array([[r[c] for c in G.FEATURES] for r in df.orderBy("cliente_id").collect()])


def test_standardize_zero_mean_unit_population_variance(scaled):
    x = matrix(scaled)
    assert np.allclose(x.mean(axis=0), 0.0, atol=1e-9)
    assert np.allclose(x.std(axis=0), 1.0, atol=1e-9)  # numpy std is the population one


def test_standardize_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 2.0)], "cliente_id long, a double, b double")
    out = G.standardize(df, ["a", "b"]).collect()
    assert [r.a for r in out] == [0.0, 0.0] and sorted(r.b for r in out) == [-1.0, 1.0]


def test_kmeans_best_restart_and_nearest_centres(scaled):
    labelled, model, cost = G.kmeans_segments(scaled, restarts=4)
    assert labelled.select("cluster_raw").distinct().count() == 5
    # kept cost is the least of the restarts
    vec = G.assemble(scaled)
    for i in range(4):
        other = KMeans(k=5, seed=42 + i, maxIter=100).fit(vec.repartition(1, "cliente_id").sortWithinPartitions("cliente_id"))
        assert cost <= other.summary.trainingCost + 1e-6
    # every client sits at its nearest centre
    centres = np.array(model.clusterCenters())
    x = matrix(scaled)
    lab = np.array([r.cluster_raw for r in labelled.orderBy("cliente_id").collect()])
    nearest = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == lab).all()


def test_kmeans_repeatable(scaled):
    a, _, ca = G.kmeans_segments(scaled, restarts=2)
    b, _, cb = G.kmeans_segments(scaled, restarts=2)
    assert ca == cb
    assert a.join(b.withColumnRenamed("cluster_raw", "c2"), "cliente_id").where(F.col("cluster_raw") != F.col("c2")).count() == 0


def test_pca_axes(scaled):
    pts = G.pca_2d(scaled)
    xy = np.array([(r.pca_x, r.pca_y) for r in pts.collect()])
    assert xy.shape == (1500, 2)
    assert xy[:, 0].var() >= xy[:, 1].var()
    # compare with numpy's principal axes (up to the sign rule: largest loading positive)
    x = matrix(scaled)
    cov = np.cov(x, rowvar=False)
    w, v = np.linalg.eigh(cov)
    v = v[:, ::-1][:, :2]
    for j in range(2):
        if v[np.abs(v[:, j]).argmax(), j] < 0:
            v[:, j] *= -1
    ref = np.round(x @ v, 3)
    got = np.array([(r.pca_x, r.pca_y) for r in pts.orderBy("cliente_id").collect()])
    assert np.abs(ref - got).max() <= 1e-3 + 1e-9


def test_roles_are_a_bijection(scaled, model_mid):
    m = model_mid
    master = M.client_master(m.clients, m.sales, m.products, m.visits, m.potential, m.horizon)
    labelled, _, _ = G.kmeans_segments(scaled, restarts=2)
    lm = master.join(labelled, "cliente_id")
    roles = G.segment_roles(G.cluster_profile(lm)).collect()
    assert sorted(r.cluster_raw for r in roles) == [0, 1, 2, 3, 4]
    assert sorted(r.cluster_code for r in roles) == sorted(s.code for s in __import__("storelens.params", fromlist=["x"]).SEGMENTS)


def test_whole_chain_covers_every_client(spark, model_small):
    import __spark_entry__ as E

    from .conftest import SF_SMALL

    rec = E.queries()["segmented_client_record"](spark, SF_SMALL)
    assert {"cluster_code", "cluster_nome", "x", "y", "faixa_fat", "status"} <= set(rec.columns)
    rows = rec.collect()
    assert len({r.id for r in rows}) == len(rows) == model_small.clients.count()
    assert all(r.x is not None and r.y is not None and r.cluster_code for r in rows)
    assert {r.faixa_fat for r in rows} == {""} and len({r.cluster_code for r in rows}) == 5
