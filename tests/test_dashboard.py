"""End-to-end batch build: every section written, and equal to the registered queries where they overlap."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from storelens.plans import dashboard

from .conftest import SF_SMALL

SECTIONS = {
    "kpis",
    "clusters",
    "clusters_distribuicoes",
    "clusters_radar",
    "clientes",
    "clientes_sparklines",
    "clientes_mix",
    "clientes_top_skus",
    "vendedores",
    "produtos",
    "cross_sell",
    "temporal",
    "visitas_padroes",
    "desconto_curva",
    "geografia",
    "perfis_vendedores",
    "curva_abc_contagem",
    "receita_categorias",
}


@pytest.fixture(scope="module")
def built(spark):
    out = tempfile.mkdtemp(prefix="storelens-dash-")
    paths = dashboard.build(spark, SF_SMALL, out, restarts=2)
    return {name: spark.read.json(p) for name, p in paths.items()}


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_every_section_written(built):
    assert set(built) == SECTIONS
    assert all(df.count() > 0 for df in built.values())


def test_sections_match_registered_queries(spark, built):
    q = E.queries()
    trend = q["monthly_trend"](spark, SF_SMALL)
    assert rows(built["temporal"], ["mes_ref", "pedidos", "clientes_ativos"]) == rows(
        trend, ["mes_ref", "pedidos", "clientes_ativos"]
    )
    cooc = q["category_cooccurrence"](spark, SF_SMALL)
    assert rows(built["cross_sell"], ["base", "other", "n_pedidos_ambos"]) == rows(
        cooc, ["base", "other", "n_pedidos_ambos"]
    )
    curve = q["visit_duration_curve"](spark, SF_SMALL)
    assert rows(built["visitas_padroes"], ["duracao_faixa", "tipo_visita", "total", "com_pedido"]) == rows(
        curve, ["duracao_faixa", "tipo_visita", "total", "com_pedido"]
    )


def test_nested_client_sections_cover_every_client(spark, built):
    n_clients = spark.read.parquet(os.path.join(SF_SMALL, "customer.parquet")).count()
    assert built["clientes"].count() == n_clients
    assert built["clientes_sparklines"].count() == n_clients
    assert built["clientes_mix"].count() == n_clients
    # the nested top-SKU lists come from the shared (client, SKU, month) pre-aggregate
    top = E.queries()["client_top_skus"](spark, SF_SMALL)
    nested = built["clientes_top_skus"].select("cliente_id", F.explode("top_skus").alias("t"))
    assert rows(nested.select("cliente_id", "t.rank", "t.sku_id"), ["cliente_id", "rank", "sku_id"]) == rows(
        top, ["cliente_id", "rank", "sku_id"]
    )
