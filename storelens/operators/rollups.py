"""Fact rollups: per client, rep, SKU, month; global KPIs.

Every rollup is one ``groupBy().agg()``: sums are partial-aggregated map
side, and distinct counts go through Catalyst's distinct-aggregate rewrite
(keys ``(group, value)`` first), so a hot client/rep/SKU holding a third of
the rows is spread over many tasks before the final, pre-aggregated shuffle.
Money is summed exactly in ``decimal(38,4)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import domains as D
from ..functions import exprs as X


def billed_sales(sales: DataFrame, status: str = P.BILLED_STATUS) -> DataFrame:
    """Order lines whose status is exactly ``status`` (base of every sales metric)."""
    return sales.where(F.col("status_pedido") == F.lit(status))


def sales_with_product(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Lines + product attributes (left join on sku_id).

    No hint: the planner broadcasts the catalogue when its estimated size is
    under ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-decides from
    the measured size, otherwise it is a sort-merge join.
    """
    prod = products.select("sku_id", "categoria", "subcategoria", "marca", "preco_lista", "custo_unitario")
    return sales.join(prod, "sku_id", "left")


def sales_with_client_geo(sales: DataFrame, clients: DataFrame) -> DataFrame:
    """Lines + client state / region / city / channel (left join on cliente_id)."""
    geo = clients.select("cliente_id", "uf", "regiao_comercial", "cidade", "canal")
    return sales.join(geo, "cliente_id", "left")


def client_sku_month(sales: DataFrame) -> DataFrame:
    """Net revenue per (client, SKU, month).

    The shared pre-aggregate of the per-client history sections (top SKUs,
    category mix, sparkline): each sums net revenue at a coarser grain, so
    they can all read this instead of the line-level fact. Sums are exact
    decimals, so re-aggregating it gives the same values.
    """
    return sales.groupBy("cliente_id", "sku_id", "mes_ref").agg(X.money_sum("receita_liquida").alias("receita_liquida"))


def _client_sales_aggs() -> list:
    return [
        X.money_sum("receita_bruta").alias("receita_bruta"),
        X.money_sum("receita_liquida").alias("receita_liquida"),
        X.money_sum("desconto").alias("desconto_total"),
        X.money_sum("custo_total").alias("custo_total"),
        X.money_sum("margem_contribuicao").alias("margem_total"),
        F.countDistinct("pedido_id").alias("total_pedidos"),
        F.coalesce(F.sum("quantidade"), F.lit(0.0)).alias("total_itens"),
        F.coalesce(F.sum("volume_kg"), F.lit(0.0)).alias("volume_total_kg"),
        F.min("data_pedido").alias("primeira_compra"),
        F.max("data_pedido").alias("ultima_compra"),
        F.countDistinct("sku_id").alias("skus_unicos"),
    ]


_SUMS = {
    "receita_bruta": "receita_bruta",
    "receita_liquida": "receita_liquida",
    "desconto": "desconto_total",
    "custo_total": "custo_total",
    "margem_contribuicao": "margem_total",
}


def _line_sums() -> list:
    """Sums of the lines of one (client, order, SKU), to be summed again by ``_client_sums_of_sums``."""
    return [
        *[X.money_sum(c).alias(n) for c, n in _SUMS.items()],
        F.sum("quantidade").alias("_itens"),
        F.sum("volume_kg").alias("_kg"),
        F.min("data_pedido").alias("_primeira"),
        F.max("data_pedido").alias("_ultima"),
    ]


def _client_sums_of_sums() -> list:
    return [
        *[X.money_sum(n).alias(n) for n in _SUMS.values()],
        F.countDistinct("pedido_id").alias("total_pedidos"),
        F.coalesce(F.sum("_itens"), F.lit(0.0)).alias("total_itens"),
        F.coalesce(F.sum("_kg"), F.lit(0.0)).alias("volume_total_kg"),
        F.min("_primeira").alias("primeira_compra"),
        F.max("_ultima").alias("ultima_compra"),
        F.countDistinct("sku_id").alias("skus_unicos"),
    ]


def client_sales(sales: DataFrame) -> DataFrame:
    """Per client: gross/net/discount/cost/margin, distinct orders and SKUs, qty, weight, first/last purchase."""
    return sales.where(F.col("cliente_id").isNotNull()).groupBy("cliente_id").agg(*_client_sales_aggs())


def client_categories(sales_with_prod: DataFrame) -> DataFrame:
    """Distinct categories bought per client."""
    return (
        sales_with_prod.where(F.col("cliente_id").isNotNull())
        .groupBy("cliente_id")
        .agg(F.countDistinct("categoria").alias("categorias_unicas"))
    )


def client_visits(visits: DataFrame) -> DataFrame:
    """Per client: visits, mean duration, planned, extra-route, converted, last visit, conversion."""
    return (
        visits.where(F.col("cliente_id").isNotNull())
        .groupBy("cliente_id")
        .agg(
            F.count("visita_id").alias("total_visitas"),
            X.mean_decimal("duracao_min", 2).alias("duracao_media_visita"),
            X.count_if(F.col("tipo_visita") == P.VISIT_PLANNED).alias("visitas_planejadas"),
            X.count_if(F.col("tipo_visita") == P.VISIT_EXTRA_ROUTE).alias("visitas_extra"),
            X.count_if(F.col("resultado_visita") == P.VISIT_CONVERTED).alias("visitas_com_pedido"),
            F.max("data_visita").alias("ultima_visita"),
        )
        .withColumn("taxa_conversao_visitas", X.ratio_nonzero_den("visitas_com_pedido", "total_visitas"))
    )


def year_column(years: Sequence[int]) -> list[str]:
    return [f"receita_{y}" for y in years]


def client_year_pivot(sales: DataFrame, years: Sequence[int] = P.YEARS) -> DataFrame:
    """Net revenue per client x year for an explicit year list, 0-filled."""
    years = list(years)
    piv = (
        sales.where(F.col("cliente_id").isNotNull())
        .withColumn("_ano", F.year("data_pedido"))
        .groupBy("cliente_id")
        .pivot("_ano", years)
        .agg(F.sum(F.col("receita_liquida").cast("decimal(38,4)")))
    )
    zero = F.lit(0).cast("decimal(38,4)")
    return piv.select(
        "cliente_id", *[F.coalesce(F.col(str(y)), zero).alias(n) for y, n in zip(years, year_column(years))]
    )


def potential_by(potential: DataFrame, keys: Sequence[str], months: int | Column | None = None, name: str | None = None) -> DataFrame:
    """Sum of monthly market potential by ``keys`` (times ``months`` when given)."""
    total = X.money_sum("mercado_estimado_mensal")
    if months is not None:
        total = total * F.lit(months)
    if name is None:
        name = "mercado_estimado_mensal" if months is None else "potencial_total"
    filt = None
    for k in keys:
        c = F.col(k).isNotNull()
        filt = c if filt is None else filt & c
    return potential.where(filt).groupBy(*keys).agg(total.alias(name))


def seller_sales(sales: DataFrame) -> DataFrame:
    """Per rep: revenue, margin, distinct orders and clients, items, discount, gross."""
    return (
        sales.where(F.col("vendedor_id").isNotNull())
        .groupBy("vendedor_id")
        .agg(
            X.money_sum("receita_liquida").alias("receita_total"),
            X.money_sum("margem_contribuicao").alias("margem_total"),
            F.countDistinct("pedido_id").alias("pedidos_total"),
            F.coalesce(F.sum("quantidade"), F.lit(0.0)).alias("itens_total"),
            F.countDistinct("cliente_id").alias("clientes_atendidos"),
            X.money_sum("desconto").alias("desconto_total"),
            X.money_sum("receita_bruta").alias("receita_bruta"),
        )
    )


def seller_visits(visits: DataFrame) -> DataFrame:
    """Per rep: visits, converted, mean duration, check-in rate (NULL counts as not ok), conversion."""
    return (
        visits.where(F.col("vendedor_id").isNotNull())
        .groupBy("vendedor_id")
        .agg(
            F.count("visita_id").alias("total_visitas"),
            X.count_if(F.col("resultado_visita") == P.VISIT_CONVERTED).alias("visitas_com_pedido"),
            X.mean_decimal("duracao_min", 2).alias("duracao_media"),
            (X.dbl(X.count_if(F.col("checkin_ok") == P.CHECKIN_OK)) / X.dbl(F.count(F.lit(1)))).alias(
                "checkin_ok_pct"
            ),
        )
        .withColumn("conversao_visitas_pct", X.ratio_nonzero_den("visitas_com_pedido", "total_visitas"))
    )


def sku_sales(sales: DataFrame) -> DataFrame:
    """Per SKU: revenue, qty, weight, margin, discount, distinct orders and clients."""
    return (
        sales.where(F.col("sku_id").isNotNull())
        .groupBy("sku_id")
        .agg(
            X.money_sum("receita_liquida").alias("receita_total"),
            F.coalesce(F.sum("quantidade"), F.lit(0.0)).alias("quantidade_total"),
            F.coalesce(F.sum("volume_kg"), F.lit(0.0)).alias("volume_kg_total"),
            X.money_sum("margem_contribuicao").alias("margem_total"),
            X.money_sum("desconto").alias("desconto_total"),
            F.countDistinct("pedido_id").alias("pedidos_total"),
            F.countDistinct("cliente_id").alias("clientes_atendidos"),
        )
    )


def monthly_trend(sales: DataFrame) -> DataFrame:
    """Per month: net, gross, discount, cost, margin, distinct orders and clients, margin %, discount %."""
    return (
        sales.where(F.col("mes_ref").isNotNull())
        .groupBy("mes_ref")
        .agg(
            X.money_sum("receita_liquida").alias("receita_liquida"),
            X.money_sum("receita_bruta").alias("receita_bruta"),
            X.money_sum("desconto").alias("desconto"),
            X.money_sum("custo_total").alias("custo_total"),
            X.money_sum("margem_contribuicao").alias("margem_contribuicao"),
            F.countDistinct("pedido_id").alias("pedidos"),
            F.countDistinct("cliente_id").alias("clientes_ativos"),
        )
        .withColumn("margem_pct", X.try_ratio("margem_contribuicao", "receita_liquida"))
        .withColumn("desconto_pct", X.try_ratio("desconto", "receita_bruta"))
    )


def kpis_global(sales: DataFrame, clients: DataFrame, visits: DataFrame) -> DataFrame:
    """One row of totals and ratios, rounded as in the published document (percentages x 100)."""
    s = sales.agg(
        X.money_sum("receita_liquida").alias("rl"),
        X.money_sum("receita_bruta").alias("rb"),
        X.money_sum("desconto").alias("dt"),
        X.money_sum("margem_contribuicao").alias("mt"),
        F.countDistinct("pedido_id").alias("total_pedidos"),
        F.countDistinct("cliente_id").alias("total_clientes_ativos"),
    )
    c = clients.agg(F.count(F.lit(1)).alias("total_clientes_base"))
    v = visits.agg(
        F.count(F.lit(1)).alias("total_visitas"),
        X.count_if(F.col("resultado_visita") == P.VISIT_CONVERTED).alias("_conv"),
    )
    # the client and visit totals are scalar subqueries on the sales row
    cv = s.withColumns({"_c": D.one_row(c), "_v": D.one_row(v)})
    row = cv.select("*", "_c.total_clientes_base", "_v.total_visitas", "_v._conv")
    return row.select(
        X.round_money("rl").alias("receita_liquida_total"),
        X.round_money("rb").alias("receita_bruta_total"),
        X.round_money("dt").alias("desconto_total"),
        X.round_money("mt").alias("margem_total"),
        X.round_half_up(X.try_ratio("mt", "rl") * 100, 2).alias("margem_pct_media"),
        X.round_half_up(X.try_ratio("dt", "rb") * 100, 2).alias("desconto_pct_medio"),
        "total_pedidos",
        X.round_half_up(X.try_ratio("rl", "total_pedidos"), 2).alias("ticket_medio"),
        "total_clientes_base",
        "total_clientes_ativos",
        X.round_half_up(X.try_ratio("total_clientes_ativos", "total_clientes_base") * 100, 1).alias(
            "taxa_ativacao_pdvs"
        ),
        "total_visitas",
        X.round_half_up(X.try_ratio("_conv", "total_visitas") * 100, 1).alias("taxa_conversao_visitas"),
    )
