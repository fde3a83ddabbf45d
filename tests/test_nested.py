"""Nested (document) forms: sparkline arrays, mix maps, top-SKU arrays, the 360 view."""

import pytest

from storelens.operators import explore as E
from storelens.operators import masters as M
from storelens.operators import ranking as K
from storelens.operators import rollups as R
from storelens.operators import segmentation as G
from storelens.plans.registry import fixed_labels


@pytest.fixture(scope="module")
def parts(model_small):
    m = model_small
    b = R.billed_sales(m.sales, m.horizon.billed_status)
    swp = R.sales_with_product(b, m.products)
    return m, b, swp


def test_sparkline_nested_in_month_order(parts):
    m, b, _ = parts
    long = K.client_sparkline(m.clients, b)
    nested = K.sparkline_nested(long).collect()
    assert len(nested) == m.clients.count()
    months = [r.mes_ref for r in K.recent_months(b).orderBy("mes_ref").collect()]
    assert all(r.meses == months and len(r.valores) == 6 for r in nested)
    # the values equal the long form rounded to 1 decimal
    by = {(r.cliente_id, r.mes_ref): round(float(r.receita_liquida), 1) for r in long.collect()}
    for r in nested[:50]:
        assert r.valores == [by[(r.cliente_id, mth)] for mth in months]


def test_mix_nested_has_every_category(parts):
    m, _, swp = parts
    cats = sorted(r[0] for r in m.products.select("categoria").distinct().collect())
    nested = K.mix_nested(K.client_category_mix(m.clients, swp, m.products)).collect()
    assert all(sorted(r.mix.keys()) == cats for r in nested)


def test_top_skus_nested_ranked(parts):
    _, b, _ = parts
    for r in K.top_skus_nested(K.client_top_skus(b)).collect():
        ranks = [t.rank for t in r.top_skus]
        vals = [t.receita_liquida for t in r.top_skus]
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 3
        assert vals == sorted(vals, reverse=True)


def test_client_360_nested(parts, spark):
    m, b, swp = parts
    master = M.client_master(m.clients, m.sales, m.products, m.visits, m.potential, m.horizon)
    lm = fixed_labels(master)
    rec = M.client_record(G.segment_labels(lm, G.segment_roles(G.cluster_profile(lm))), m.horizon.years)
    seller = M.seller_record(M.seller_master(m.sellers, m.sales, m.visits, m.horizon))
    full = E.client_360(
        rec,
        K.client_category_mix(m.clients, swp, m.products),
        K.client_top_skus(b),
        m.products,
        seller,
        K.client_sparkline(m.clients, b),
    )
    rows = full.collect()
    assert len(rows) == m.clients.count()
    inactive = [r for r in rows if r.pedidos == 0]
    assert inactive and all(r.top_skus is None and r.categorias_compradas == 0 for r in inactive)
    active = [r for r in rows if r.pedidos > 0]
    assert all(1 <= len(r.top_skus) <= 3 and r.top_skus[0].nome for r in active)
    assert all(len(r.sparkline) == 6 for r in rows)
    # the rep lookup is a left join: reps 0..9 exist among suppliers, so every client has one
    assert all(r.vendedor_nome is not None for r in rows)
