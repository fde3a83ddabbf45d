"""Master tables (client, rep, SKU) and their published record projections.

``client_master`` is the flagship: every client (inactive ones too) with the
sales rollup, categories and yearly split computed in ONE aggregation over the
billed fact (one scan, one shuffle keyed by client), the visits rollup, and the
market potential of the client's (city, channel). The potential is joined
first (AQE broadcasts it where its measured size allows, else a shuffle
join); all rollups come out hash-partitioned by ``cliente_id``, so the
left-join chain on the client key adds only the exchange of the client table
itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import exprs as X
from . import rollups as R

CLIENT_METRICS = (
    "receita_bruta",
    "receita_liquida",
    "desconto_total",
    "custo_total",
    "margem_total",
    "total_pedidos",
    "total_itens",
    "volume_total_kg",
    "skus_unicos",
    "categorias_unicas",
    "total_visitas",
    "duracao_media_visita",
    "visitas_planejadas",
    "visitas_extra",
    "visitas_com_pedido",
    "taxa_conversao_visitas",
)


def _zero_like(df: DataFrame, name: str):
    return F.lit(0).cast(df.schema[name].dataType)


def fill_metrics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULL with 0 only in the named metric columns (text and dates keep NULL)."""
    return df.withColumns({c: F.coalesce(F.col(c), _zero_like(df, c)) for c in cols})


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null policy by column, e.g. metrics 0, recency 999, checkouts 1, area 30."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items()})


def client_potential(clients: DataFrame, potential: DataFrame) -> DataFrame:
    """Client + monthly potential of its (city, channel); missing → 0."""
    pot = R.potential_by(potential, ["cidade", "canal"], name="potencial_mercado_cidade_canal_mensal")
    out = clients.join(pot, ["cidade", "canal"], "left")
    return fill_metrics(out, ["potencial_mercado_cidade_canal_mensal"])


def client_fact_rollup(billed: DataFrame, products: DataFrame, years: Sequence[int]) -> DataFrame:
    """Sales rollup + distinct categories + net per year.

    The lines are summed once to (client, order, SKU); the product join and
    the three distinct counts work on those rows, so the lines themselves are
    neither joined to products nor expanded per distinct count.
    """
    ycols = R.year_column(years)
    per_year = [
        X.money_sum(F.when(F.year("data_pedido") == F.lit(y), F.col("receita_liquida"))).alias(n)
        for y, n in zip(years, ycols)
    ]
    pre = (
        billed.where(F.col("cliente_id").isNotNull())
        .groupBy("cliente_id", "pedido_id", "sku_id")
        .agg(*R._line_sums(), *per_year)
    )
    fact = pre.join(products.select("sku_id", "categoria"), "sku_id", "left")
    return fact.groupBy("cliente_id").agg(
        *R._client_sums_of_sums(),
        F.countDistinct("categoria").alias("categorias_unicas"),
        *[X.money_sum(n).alias(n) for n in ycols],
    )


def client_master(
    clients: DataFrame,
    sales: DataFrame,
    products: DataFrame,
    visits: DataFrame,
    potential: DataFrame,
    horizon: P.Horizon = P.Horizon(),
) -> DataFrame:
    billed = R.billed_sales(sales, horizon.billed_status)
    years = list(horizon.years)
    ycols = R.year_column(years)
    roll = client_fact_rollup(billed, products, years)
    vis = R.client_visits(visits)
    pot = R.potential_by(potential, ["cidade", "canal"], name="potencial_mercado_cidade_canal_mensal")
    # (city, channel) first: where AQE measures the potential rollup as small it
    # is broadcast, and the client table is shuffled once, by cliente_id
    m = clients.join(pot, ["cidade", "canal"], "left").join(roll, "cliente_id", "left").join(vis, "cliente_id", "left")
    m = fill_metrics(m, list(CLIENT_METRICS) + ycols + ["potencial_mercado_cidade_canal_mensal"])
    m = m.withColumns(
        {
            "margem_pct": X.safe_ratio("margem_total", "receita_liquida"),
            "desconto_pct": X.safe_ratio("desconto_total", "receita_bruta"),
            "ticket_medio": X.safe_ratio("receita_liquida", "total_pedidos"),
            "recencia_dias": X.recency_days("ultima_compra", horizon.reference_date),
            "crescimento_yoy": X.yoy_growth(ycols[0], ycols[1]),
        }
    )
    return m


def seller_master(
    sellers: DataFrame, sales: DataFrame, visits: DataFrame, horizon: P.Horizon = P.Horizon()
) -> DataFrame:
    """Reps + sales + visits rollups, metrics 0-filled, attainment, quadrant."""
    billed = R.billed_sales(sales, horizon.billed_status)
    m = sellers.join(R.seller_sales(billed), "vendedor_id", "left").join(R.seller_visits(visits), "vendedor_id", "left")
    m = fill_metrics(
        m,
        [
            "receita_total",
            "margem_total",
            "pedidos_total",
            "itens_total",
            "clientes_atendidos",
            "desconto_total",
            "receita_bruta",
            "total_visitas",
            "visitas_com_pedido",
            "duracao_media",
            "checkin_ok_pct",
            "conversao_visitas_pct",
        ],
    )
    return seller_attainment(m, horizon.months)


def seller_attainment(df: DataFrame, months: int | Column = P.HORIZON_MONTHS) -> DataFrame:
    """Period target, revenue/margin attainment, visits per month, capacity use, quadrant."""
    df = df.withColumns(
        {
            "meta_receita_periodo": F.col("meta_receita_mensal").cast("decimal(38,4)") * F.lit(months),
            "margem_realizada_pct": X.safe_ratio("margem_total", "receita_total"),
            "desconto_medio_pct": X.safe_ratio("desconto_total", "receita_bruta"),
            "visitas_mes_realizadas": X.dbl("total_visitas") / F.lit(months).cast("double"),
        }
    )
    df = df.withColumns(
        {
            "atingimento_receita_pct": X.try_ratio("receita_total", "meta_receita_periodo"),
            "atingimento_margem_pct": X.try_ratio("margem_realizada_pct", "meta_margem_pct"),
            "aproveitamento_capacidade_visitas": X.try_ratio("visitas_mes_realizadas", "capacidade_visitas_mes"),
        }
    )
    return df.withColumn(
        "perfil_vendedor", X.seller_quadrant("atingimento_receita_pct", "margem_realizada_pct", "meta_margem_pct")
    )


def sku_master(products: DataFrame, sales: DataFrame, horizon: P.Horizon = P.Horizon()) -> DataFrame:
    """All SKUs + sales rollup, metrics 0-filled (substitute SKU stays NULL), ratios."""
    billed = R.billed_sales(sales, horizon.billed_status)
    m = products.join(R.sku_sales(billed), "sku_id", "left")
    m = fill_metrics(
        m,
        [
            "receita_total",
            "quantidade_total",
            "volume_kg_total",
            "margem_total",
            "desconto_total",
            "pedidos_total",
            "clientes_atendidos",
        ],
    )
    return m.withColumns(
        {
            "margem_pct": X.safe_ratio("margem_total", "receita_total"),
            "desconto_medio_pct": X.safe_ratio(
                "desconto_total", F.col("receita_total") + F.col("desconto_total")
            ),
            "ticket_medio_item": X.safe_ratio("receita_total", "pedidos_total"),
        }
    )


# ---------------------------------------------------------------------------
# Published record projections (rounded, percentages x 100, dates as text)
# ---------------------------------------------------------------------------


def _int_or_zero(c: str):
    return F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))


def client_record(master: DataFrame, years: Sequence[int] = P.YEARS, with_coords: bool | None = None) -> DataFrame:
    """Per-client published record. Cluster fields are taken when present; PCA x/y when present."""
    y0, y1 = R.year_column(years)
    cols = [
        F.col("cliente_id").alias("id"),
        F.col("nome_cliente_ficticio").alias("nome"),
        "canal",
        "porte",
        "cidade",
        "uf",
        F.col("regiao_comercial").alias("regiao"),
        "vendedor_id",
        _int_or_zero("n_checkouts").alias("checkouts"),
        _int_or_zero("area_loja_m2").alias("area_m2"),
        F.coalesce("faixa_faturamento_pdv", F.lit("")).alias("faixa_fat"),
        X.date_text("data_cadastro").alias("data_cad"),
        F.coalesce("status_cliente", F.lit("")).alias("status"),
    ]
    for src, dst in (
        ("cluster_raw", "cluster_raw"),
        ("cluster_nome", "cluster_nome"),
        ("cluster_code", "cluster_code"),
        ("cluster_tag", "cluster_tag"),
    ):
        if src in master.columns:
            cols.append(F.col(src).alias(dst))
    if with_coords is None:
        with_coords = "pca_x" in master.columns
    if with_coords:
        cols += [F.col("pca_x").alias("x"), F.col("pca_y").alias("y")]
    cols += [
        X.round_money("receita_bruta").alias("rec_bruta"),
        X.round_money("receita_liquida").alias("rec_liq"),
        X.round_money("margem_total").alias("margem"),
        X.round_half_up(F.col("margem_pct") * 100, 2).alias("margem_pct"),
        X.round_money("desconto_total").alias("desconto"),
        X.round_half_up(F.col("desconto_pct") * 100, 2).alias("desconto_pct"),
        F.col("total_pedidos").cast("long").alias("pedidos"),
        F.col("total_itens").cast("long").alias("itens"),
        X.round_half_up("volume_total_kg", 1).alias("volume_kg"),
        X.round_half_up("ticket_medio", 2).alias("ticket_medio"),
        F.col("skus_unicos").cast("long").alias("skus"),
        F.col("categorias_unicas").cast("long").alias("categorias"),
        F.col("recencia_dias").cast("long").alias("recencia_dias"),
        X.date_text("primeira_compra").alias("primeira_compra"),
        X.date_text("ultima_compra").alias("ultima_compra"),
        F.col("total_visitas").cast("long").alias("visitas"),
        F.col("visitas_com_pedido").cast("long").alias("visitas_pedidos"),
        X.round_half_up(F.col("taxa_conversao_visitas") * 100, 1).alias("conv_visitas"),
        X.round_money(y0).alias(f"rec_{years[0]}"),
        X.round_money(y1).alias(f"rec_{years[1]}"),
        X.round_half_up(F.col("crescimento_yoy") * 100, 1).alias("cresc_yoy"),
        X.round_money("potencial_mercado_cidade_canal_mensal").alias("potencial_cidade"),
    ]
    return master.select(*cols)


def seller_record(master: DataFrame) -> DataFrame:
    """Per-rep published record (21 fields)."""
    return master.select(
        F.col("vendedor_id").alias("id"),
        F.col("nome_vendedor_ficticio").alias("nome"),
        F.col("regiao_comercial").alias("regiao"),
        X.date_text("data_admissao").alias("admissao"),
        X.dbl("custo_mensal_total").alias("custo_mensal"),
        X.dbl("meta_receita_mensal").alias("meta_rec_mensal"),
        X.round_half_up(F.col("meta_margem_pct") * 100, 2).alias("meta_margem_pct"),
        X.round_money("receita_total").alias("rec_total"),
        X.round_money("margem_total").alias("margem_total"),
        X.round_half_up(F.col("margem_realizada_pct") * 100, 2).alias("margem_pct"),
        F.col("pedidos_total").cast("long").alias("pedidos"),
        F.col("clientes_atendidos").cast("long").alias("clientes_ativos"),
        F.col("total_visitas").cast("long").alias("visitas_total"),
        F.col("visitas_com_pedido").cast("long").alias("visitas_pedidos"),
        X.round_half_up(F.col("conversao_visitas_pct") * 100, 1).alias("conv_visitas"),
        X.round_half_up(F.col("atingimento_receita_pct") * 100, 1).alias("ating_rec_pct"),
        X.round_half_up(F.col("atingimento_margem_pct") * 100, 1).alias("ating_margem_pct"),
        X.round_half_up(F.col("desconto_medio_pct") * 100, 2).alias("desconto_pct"),
        X.round_half_up(F.col("checkin_ok_pct") * 100, 1).alias("checkin_pct"),
        F.col("perfil_vendedor").alias("perfil"),
        F.col("capacidade_visitas_mes").cast("long").alias("capacidade_visitas"),
    )


def sku_record(master: DataFrame) -> DataFrame:
    """Per-SKU published record (20 fields); expects the ABC class column ``curva_abc``."""
    return master.select(
        "sku_id",
        F.col("sku_nome").alias("nome"),
        "categoria",
        "subcategoria",
        "marca",
        "formato",
        "volume",
        X.dbl("preco_lista").alias("preco_lista"),
        X.dbl("custo_unitario").alias("custo_unit"),
        F.col("status_sku").alias("status"),
        F.col("substituto_sku_id").alias("substituto"),
        X.round_money("receita_total").alias("rec_total"),
        F.col("quantidade_total").cast("long").alias("qtd_total"),
        X.round_half_up("volume_kg_total", 1).alias("volume_kg"),
        X.round_money("margem_total").alias("margem_total"),
        X.round_half_up(F.col("margem_pct") * 100, 2).alias("margem_pct"),
        X.round_half_up(F.col("desconto_medio_pct") * 100, 2).alias("desconto_pct"),
        "curva_abc",
        F.col("pedidos_total").cast("long").alias("pedidos"),
        F.col("clientes_atendidos").cast("long").alias("clientes"),
    )
