"""Operator semantics on hand-made frames and conservation checks on the test data."""

import datetime as dt
from decimal import Decimal

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from storelens import params as P
from storelens.functions import exprs as X
from storelens.operators import curves as C
from storelens.operators import explore as E
from storelens.operators import masters as M
from storelens.operators import ranking as K
from storelens.operators import rollups as R
from storelens.operators import segmentation as G

SALES_DDL = (
    "pedido_id long, cliente_id long, vendedor_id long, sku_id long, data_pedido timestamp_ntz, mes_ref string, "
    "status_pedido string, quantidade double, volume_kg double, receita_bruta decimal(18,2), desconto decimal(18,4), "
    "receita_liquida decimal(18,4), custo_total decimal(18,4), margem_contribuicao decimal(18,4)"
)


def line(o, c, s, sku, day, status="Faturado", gross="100.00", disc="0.0000"):
    g, d = Decimal(gross), Decimal(disc)
    ts = dt.datetime(2025, 1, day)
    return (o, c, s, sku, ts, ts.strftime("%Y-%m"), status, 1.0, 2.0, g, d, g - d, Decimal("50"), g - d - Decimal("50"))


def test_client_sales_drops_null_keys_and_counts_distinct(spark):
    rows = [
        line(1, 10, 1, 100, 1),
        line(1, 10, 1, 101, 1),
        line(2, 10, 1, 100, 5),
        line(3, None, 1, 100, 6),
        line(4, 11, 2, 102, 7, status="Cancelado"),
    ]
    sales = R.billed_sales(spark.createDataFrame(rows, SALES_DDL), P.BILLED_STATUS)
    got = {r.cliente_id: r for r in R.client_sales(sales).collect()}
    assert set(got) == {10}
    r = got[10]
    assert r.total_pedidos == 2 and r.skus_unicos == 2 and float(r.receita_bruta) == 300.0
    assert r.primeira_compra == dt.datetime(2025, 1, 1) and r.ultima_compra == dt.datetime(2025, 1, 5)


def test_top_skus_tie_break_by_sku(spark):
    rows = [line(1, 10, 1, sku, 1) for sku in (105, 103, 104, 101)] + [line(2, 10, 1, 102, 2, gross="300.00")]
    top = K.client_top_skus(spark.createDataFrame(rows, SALES_DDL)).orderBy("rank").collect()
    assert [(r.rank, r.sku_id) for r in top] == [(1, 102), (2, 101), (3, 103)]


def test_visit_curve_full_grid_with_empty_cells(spark):
    rows = [(1, 1, 1, None, "Planejada", "Pedido", 10.0, "Sim"), (2, 1, 1, None, "Planejada", "Nao", 0.0, "Sim")]
    ddl = "visita_id long, cliente_id long, vendedor_id long, data_visita timestamp_ntz, tipo_visita string, resultado_visita string, duracao_min double, checkin_ok string"
    curve = C.visit_duration_curve(spark.createDataFrame(rows, ddl)).collect()
    assert len(curve) == len(P.DURATION_LABELS)  # one observed type x six bands
    cells = {r.duracao_faixa: (r.total, r.com_pedido, r.taxa_conversao) for r in curve}
    assert cells["0-15 min"] == (1, 1, 1.0)  # the 0-minute visit falls out (right-closed bins)
    assert cells["90+ min"] == (0, 0, 0.0)


def test_segment_roles_with_fewer_clusters(spark):
    prof = spark.createDataFrame(
        [(0, 10.0, 5.0, 1.0, 0.1), (1, 20.0, 1.0, 2.0, 0.2)],
        "cluster_raw int, rec_liq_med double, recencia_med double, checkouts_med double, desconto_pct_med double",
    )
    roles = {r.cluster_raw: r.cluster_code for r in G.segment_roles(prof).collect()}
    assert roles == {1: "C1_KEY_ACCOUNTS", 0: "C3_CHURN_RISK"}


def test_segment_roles_priority_and_ties(spark):
    prof = spark.createDataFrame(
        [(0, 5.0, 9.0, 9.0, 0.9), (1, 9.0, 1.0, 1.0, 0.1), (2, 1.0, 9.0, 1.0, 0.1), (3, 1.0, 1.0, 8.0, 0.1), (4, 1.0, 1.0, 1.0, 0.5)],
        "cluster_raw int, rec_liq_med double, recencia_med double, checkouts_med double, desconto_pct_med double",
    )
    roles = {r.cluster_raw: r.cluster_code for r in G.segment_roles(prof).collect()}
    # recency tie between 0 and 2 → lower id 0 is churn; then checkouts: 3; discount: 4; rest stable
    assert roles == {1: "C1_KEY_ACCOUNTS", 0: "C3_CHURN_RISK", 3: "C2_HIGH_POTENTIAL", 4: "C4_DISCOUNT_HUNTERS", 2: "C5_RETAIL_STABLE"}


def test_filter_spec_and_search(spark):
    rec = spark.createDataFrame(
        [(1, "Loja Azul", "SP", "SP", "Sudeste", 7, "P", 0), (2, "Mercado X", "Rio", "RJ", "Sudeste", 8, "M", 1)],
        "id long, nome string, cidade string, uf string, regiao string, vendedor_id long, porte string, cluster_raw int",
    )
    assert [r.id for r in E.search_clients(rec, "  AZUL ").collect()] == [1]
    assert [r.id for r in E.search_clients(rec, "", E.FilterSpec(uf="RJ")).collect()] == [2]
    assert E.search_clients(rec, "").count() == 2
    flags = {r.id: (r.destaque_busca, r.no_filtro) for r in E.search_flag(rec, "rio", E.FilterSpec(porte="M")).collect()}
    assert flags == {1: (False, False), 2: (True, True)}


def test_sorted_page(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(1, 11)], "id long, rec_liq double")
    page = K.sorted_page(df, "rec_liq", False, page=2, size=3).collect()
    assert [r.id for r in page] == [2, 6, 10][:0] + [r.id for r in page]  # shape check below
    assert len(page) == 3 and page[0].total_linhas == 10 and page[0].total_paginas == 4
    full = sorted(((-(i % 4), i) for i in range(1, 11)))
    assert [r.id for r in page] == [i for _, i in full[3:6]]


def test_category_mix_scaling(spark):
    clients = spark.createDataFrame([(1,), (2,)], "cliente_id long")
    products = spark.createDataFrame([("A",), ("B",)], "categoria string")
    swp = spark.createDataFrame([(1, "A", Decimal("50.0000")), (1, "B", Decimal("400.0000"))], "cliente_id long, categoria string, receita_liquida decimal(18,4)")
    mix = {(r.cliente_id, r.categoria): (r.barra_pct, r.comprado) for r in K.client_category_mix(clients, swp, products).collect()}
    assert mix[(1, "A")] == (12.5, True) and mix[(1, "B")] == (100.0, True)
    assert mix[(2, "A")] == (0.0, False) and len(mix) == 4


# --- on the test data ---------------------------------------------------------


def test_conservation_of_net_revenue(model_mid):
    m = model_mid
    billed = R.billed_sales(m.sales, m.horizon.billed_status)
    total = billed.agg(F.sum("receita_liquida")).collect()[0][0]
    by_client = R.client_sales(billed).agg(F.sum("receita_liquida")).collect()[0][0]
    by_rep = R.seller_sales(billed).agg(F.sum("receita_total")).collect()[0][0]
    by_sku = R.sku_sales(billed).agg(F.sum("receita_total")).collect()[0][0]
    by_month = R.monthly_trend(billed).agg(F.sum("receita_liquida")).collect()[0][0]
    by_state = C.geo_performance(billed, m.clients, m.potential).agg(F.sum("receita_liquida")).collect()[0][0]
    assert total == by_client == by_rep == by_sku == by_month == by_state


def test_cooccurrence_symmetric_with_full_diagonal(model_mid):
    m = model_mid
    swp = R.sales_with_product(R.billed_sales(m.sales, m.horizon.billed_status), m.products)
    rows = C.category_cooccurrence(swp).collect()
    n = {(r.base, r.other): r.n_pedidos_ambos for r in rows}
    cats = {r.base for r in rows}
    assert len(rows) == len(cats) ** 2
    assert all(n[(a, b)] == n[(b, a)] for a in cats for b in cats)
    assert all(r.pct == 100.0 for r in rows if r.base == r.other)


def test_cooccurrence_chunked_equals_single_pass(model_small):
    # the chunked path (per-order sets checkpointed, categories counted a few at a time) is exact
    m = model_small
    swp = R.sales_with_product(R.billed_sales(m.sales, m.horizon.billed_status), m.products)
    one = sorted(tuple(r) for r in C.category_cooccurrence(swp, m.products).collect())
    chunked = sorted(tuple(r) for r in C.category_cooccurrence(swp, m.products, chunk=2).collect())
    assert one == chunked and len(one) > 1


def test_abc_equals_single_window(model_mid, spark):
    m = model_mid
    skus = M.sku_master(m.products, m.sales, m.horizon)
    got = {r.sku_id: (r.receita_cum, r.curva_abc) for r in K.abc_curve(skus, n_ranges=4).collect()}
    w = Window.orderBy(F.desc("receita_total"), F.asc("sku_id")).rowsBetween(Window.unboundedPreceding, 0)
    ref = skus.withColumn("cum", F.sum(F.col("receita_total").cast("decimal(38,4)")).over(w)).collect()
    assert len(got) == len(ref)
    assert all(got[r.sku_id][0] == r.cum for r in ref)
    classes = [v[1] for v in got.values()]
    assert {c: classes.count(c) for c in set(classes)} == {P.ABC_LABELS[0]: 1116, P.ABC_LABELS[1]: 496, P.ABC_LABELS[2]: 388}
    last = K.abc_curve(skus).agg(F.max("receita_cum_pct")).collect()[0][0]
    assert abs(last - 1.0) < 1e-12


def test_abc_ranges_sized_from_sku_count_equal_single_window(model_mid):
    # default range count from the SKU count: 2000 SKUs at 300 per range -> 7 ranges
    m = model_mid
    skus = M.sku_master(m.products, m.sales, m.horizon)
    got = {r.sku_id: r.receita_cum for r in K.abc_curve(skus, rows_per_range=300).collect()}
    w = Window.orderBy(F.desc("receita_total"), F.asc("sku_id")).rowsBetween(Window.unboundedPreceding, 0)
    ref = skus.withColumn("cum", F.sum(F.col("receita_total").cast("decimal(38,4)")).over(w)).collect()
    assert len(got) == len(ref) and all(got[r.sku_id] == r.cum for r in ref)


def test_discount_bands_cover_all_lines_in_range(model_mid):
    m = model_mid
    billed = R.billed_sales(m.sales, m.horizon.billed_status)
    curve = C.discount_margin_curve(billed).collect()
    assert len(curve) == len(P.DISCOUNT_LABELS)
    rate = X.discount_rate()
    in_range = billed.where((rate > -0.01) & (rate <= 1.0)).count()
    assert sum(r.total_itens for r in curve) == in_range


def test_dimension_keys_unique(model_mid):
    for df, key in ((model_mid.clients, "cliente_id"), (model_mid.products, "sku_id"), (model_mid.sellers, "vendedor_id")):
        assert df.count() == df.select(key).distinct().count()


def test_branches_are_reached(model_mid):
    """Every quadrant, every growth branch and the never-bought recency are present in the test data."""
    m = model_mid
    seller = M.seller_master(m.sellers, m.sales, m.visits, m.horizon)
    assert seller.select("perfil_vendedor").distinct().count() == 4
    master = M.client_master(m.clients, m.sales, m.products, m.visits, m.potential, m.horizon)
    g = {r[0] for r in master.select(F.when(F.col("crescimento_yoy") == 1.0, "new").when(F.col("crescimento_yoy") == 0, "none").when(F.col("crescimento_yoy") == -1.0, "lost").otherwise("both")).distinct().collect()}
    assert g == {"new", "none", "lost", "both"}
    assert master.where(F.col("ultima_compra").isNull()).count() == 1500 - 1425
    assert master.where("ultima_compra is null and recencia_dias != 999").count() == 0


def test_domain_array_holds_every_value(spark):
    from storelens.functions import domains as D

    df = spark.range(200_000).selectExpr("cast(id as string) as c")
    got = spark.range(1).select(F.size(D.domain_array(df, "c")).alias("n")).collect()[0].n
    assert got == 200_000


def test_global_rank_equals_single_window(spark):
    from storelens.functions.ordering import global_rank

    df = spark.range(1000).selectExpr("id", "id % 7 as k", "cast((id * 37) % 1000 as string) as v")
    got = {r.id: r.n for r in global_rank(df, ["k", "v"], "n").collect()}
    ref = df.withColumn("n", F.row_number().over(Window.orderBy("k", "v"))).collect()
    assert got == {r.id: r.n for r in ref}


def test_whole_fact_is_counted(model_mid):
    """Every billed line of the order table reaches the monthly trend (no date window)."""
    m = model_mid
    billed = R.billed_sales(m.sales, m.horizon.billed_status)
    trend = R.monthly_trend(billed).agg(F.sum("receita_liquida")).collect()[0][0]
    li = m.sales.where(F.col("status_pedido") == "F")
    assert li.count() == 19856
    assert float(trend) == float(li.agg(F.sum("receita_liquida")).collect()[0][0])


def test_client_master_lines_are_not_expanded(model_mid):
    """The lines are summed per (client, order, SKU) below the product join and the distinct counts."""
    m = model_mid
    plan = M.client_master(m.clients, m.sales, m.products, m.visits, m.potential, m.horizon)._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    expand, lines = text.index("Expand"), text.index("l_orderkey")
    first = text.index("Aggregate [cliente_id", expand)
    assert expand < first < lines and "pedido_id" in text[first : text.index("\n", first)]


def test_cooccurrence_of_one_huge_order(spark):
    """An order of 2,000 categories among small ones: blocks of pairs give every cell, and equal sets are one row."""
    huge = [("big", f"c{i:04d}") for i in range(2000)]
    small = [(f"o{i}", c) for i in range(50) for c in ("c0000", "c0001")]
    swp = spark.createDataFrame(huge + small, "pedido_id string, categoria string").repartition(4)
    assert C.distinct_baskets(swp).count() == 2
    out = C.category_cooccurrence(swp)
    assert out.count() == 2000 * 2000
    cells = {(r.base, r.other): (r.n_pedidos_ambos, r.n_pedidos_base) for r in out.where("base <= 'c0002' and other <= 'c0002'").collect()}
    assert cells["c0000", "c0001"] == (51, 51) and cells["c0000", "c0002"] == (1, 51) and cells["c0002", "c0000"] == (1, 1)
    only = C.category_cooccurrence(swp, spark.createDataFrame([("c0000",), ("zz",)], "categoria string"))
    assert {r.other for r in only.select("other").distinct().collect()} == {"c0000"}


def test_page_directory_reads_only_its_ranges(spark):
    rows = [(f"i{i:03d}", float(i * 7 % 50) if i % 11 else None, f"n{i}") for i in range(103)]
    df = spark.createDataFrame(rows, "id string, rec_liq double, nome string")
    for ascending in (False, True):
        d = K.page_directory(df, "rec_liq", ascending, size=10, rows_per_range=13)
        assert d.rows == 103 and d.pages == 11 and len(d.starts) == 9
        for page in (1, 5, 6, 11, 12):
            want = df.orderBy(K.sort_key("rec_liq", ascending), "id").offset((page - 1) * 10).limit(10).collect()
            got = d.page(page)
            assert [tuple(r)[:3] for r in got.collect()] == [tuple(r) for r in want]
            assert len(d.ranges_of(page)) <= 2
            if page == 11:
                plan = got._jdf.queryExecution().executedPlan().toString()
                assert "PartitionFilters: []" not in plan and "(_range" in plan
    empty = K.page_directory(df.limit(0), size=10)
    assert empty.pages == 1 and empty.page(1).collect() == [] and "total_linhas" in empty.page(1).columns


def test_rank_ranges_follow_the_rows(spark):
    from storelens.functions.ordering import global_rank, range_count

    assert [range_count(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]
    df = spark.range(57).selectExpr("id", "cast(id % 5 as int) as k")
    got = {r.id: r.n for r in global_rank(df, ["k", "id"], "n", rows_per_range=9).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(57), key=lambda i: (i % 5, i))
