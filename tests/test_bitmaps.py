"""Merged bitmaps give exact distinct counts at every grain."""

import random

import pytest
from pyspark.sql import functions as F

from storelens.operators import bitmaps as B
from storelens.operators import rollups as R

GRAINS = [[], ["mes_ref"], ["uf"], ["mes_ref", "uf"]]


def lines(n=3000, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        order = rng.choice([None, -7, 10**15, *range(400)])
        # a few orders lie in two months and belong to two clients; client 0 holds a third of the lines
        client = 0 if rng.random() < 0.33 else rng.choice([None, 999, *range(1, 50)])
        out.append((order, client, rng.choice([None, "2020-01", "2020-02", "2020-03"])))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    sales = spark.createDataFrame(lines(), "pedido_id long, cliente_id long, mes_ref string")
    clients = spark.createDataFrame([(i, f"U{i % 3}" if i % 7 else None) for i in range(50)], "cliente_id long, uf string")
    return sales, clients


@pytest.mark.parametrize("by", GRAINS)
def test_counts_equal_count_distinct(tables, by):
    sales, clients = tables
    state = B.distinct_state(sales, clients, rows_per_range=64)
    want = (
        sales.join(clients, "cliente_id", "left")
        .groupBy(*by)
        .agg(F.countDistinct("pedido_id").alias("pedidos"), F.countDistinct("cliente_id").alias("clientes"))
        .where("pedidos + clientes > 0")
    )
    assert sorted(B.distinct_counts(state, by).collect(), key=str) == sorted(want.collect(), key=str)


def test_states_merge_step_by_step(tables):
    state = B.distinct_state(*tables)
    by_month = B.merge_bitmaps(state, ["mes_ref"])
    assert B.distinct_counts(by_month).collect() == B.distinct_counts(state).collect()


def test_ids_of_a_cell_are_neighbours(spark):
    """Orders of three months, their ids interleaved: every month fills blocks of its own."""
    n = 3 * 40_000
    rows = spark.range(n).select(F.col("id").alias("pedido_id"), (F.col("id") % 3).alias("mes_ref"))
    blocks = B.id_bitmaps(rows, "pedido_id", ["mes_ref"]).groupBy("mes_ref").count().collect()
    assert sorted((r.mes_ref, r["count"]) for r in blocks) == [(0, 2), (1, 2), (2, 2)]


def test_empty_sales(tables):
    sales, clients = tables
    state = B.distinct_state(sales.limit(0), clients)
    assert state.count() == 0
    assert B.distinct_counts(state).collect() == [(0, 0)]


def test_equals_the_rollups(model_small):
    m = model_small
    billed = R.billed_sales(m.sales, m.horizon.billed_status)
    state = B.distinct_state(billed, m.clients)
    got = B.distinct_counts(state, ["mes_ref"]).collect()
    want = R.monthly_trend(billed).select("mes_ref", "pedidos", "clientes_ativos").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)
