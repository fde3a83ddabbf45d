"""Banding curves, category co-occurrence and geographic performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import domains as D
from ..functions import exprs as X
from ..session import cut_lineage
from . import rollups as R

OUT_OF_BANDS = "(fora das faixas)"  # internal group key of values outside every band


def visit_duration_curve(
    visits: DataFrame,
    edges: Sequence[float] = P.DURATION_EDGES,
    labels: Sequence[str] = P.DURATION_LABELS,
) -> DataFrame:
    """Visits per duration band x visit type: total, converted, conversion; full grid incl. empty cells.

    Bands are right-closed, so a duration of 0 or above the last edge falls
    out. The band labels are a fixed list, so one aggregation per visit type
    counts every band (total and converted) as conditional counts, and the
    counts are unpivoted to (band, type): one scan of the visits, no grid join,
    and every band x every observed visit type is present (empty cells are 0).
    """
    banded = visits.where(F.col("tipo_visita").isNotNull()).withColumn(
        "_faixa", X.band("duracao_min", edges, labels)
    )
    converted = F.col("resultado_visita") == P.VISIT_CONVERTED
    in_band = [F.col("_faixa") == F.lit(lab) for lab in labels]
    per_type = banded.groupBy("tipo_visita").agg(
        *[X.count_if(c & F.col("visita_id").isNotNull()).alias(f"_t{i}") for i, c in enumerate(in_band)],
        *[X.count_if(c & converted).alias(f"_c{i}") for i, c in enumerate(in_band)],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(lab).alias("duracao_faixa"), F.col(f"_t{i}").alias("total"), F.col(f"_c{i}").alias("com_pedido")
            )
            for i, lab in enumerate(labels)
        ]
    )
    out = per_type.select("tipo_visita", F.inline(cells)).select("duracao_faixa", "tipo_visita", "total", "com_pedido")
    return out.withColumn("taxa_conversao", X.ratio_nonzero_den("com_pedido", "total"))


def visit_conversion_pivot(
    curve: DataFrame,
    labels: Sequence[str] = P.DURATION_LABELS,
    types: Sequence[str] = P.VISIT_TYPES,
) -> DataFrame:
    """Conversion % (x100, 1 decimal) per band in fixed order, one column per visit type, missing → 0."""
    names = {P.VISIT_PLANNED: "planejada_pct", P.VISIT_EXTRA_ROUTE: "extra_rota_pct"}
    pct = curve.withColumn("conversao_pct", X.round_half_up(F.col("taxa_conversao") * 100, 1))
    piv = pct.groupBy("duracao_faixa").pivot("tipo_visita", list(types)).agg(F.first("conversao_pct"))
    order = D.with_domain(curve.sparkSession.range(1), "duracao_faixa", list(labels)).select("duracao_faixa")
    out = order.join(piv, "duracao_faixa", "left")
    return out.select(
        "duracao_faixa",
        X.band_order("duracao_faixa", labels).alias("ordem"),
        *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(names.get(t, t)) for t in types],
    )


def discount_margin_curve(
    sales: DataFrame,
    edges: Sequence[float] = P.DISCOUNT_EDGES,
    labels: Sequence[str] = P.DISCOUNT_LABELS,
) -> DataFrame:
    """Lines by discount-rate band: lines, net, discount, margin, margin %; every band present."""
    # Rates outside every band get a sentinel label instead of NULL: the key is
    # then non-nullable, so no "band IS NOT NULL" filter is inferred and pushed
    # through the aggregate into the scan (where it would re-evaluate the whole
    # band expression per branch). The label grid below drops the sentinel.
    key = F.coalesce(X.band(X.discount_rate(), edges, labels), F.lit(OUT_OF_BANDS))
    agg = (
        sales.withColumn("faixa_desconto", key)
        .groupBy("faixa_desconto")
        .agg(
            F.count("pedido_id").alias("total_itens"),
            X.money_sum("receita_liquida").alias("receita_liquida"),
            X.money_sum("desconto").alias("desconto_total"),
            X.money_sum("margem_contribuicao").alias("margem_total"),
        )
    )
    grid = D.with_domain(sales.sparkSession.range(1), "faixa_desconto", list(labels)).select("faixa_desconto")
    zero = F.lit(0).cast("decimal(38,4)")
    out = grid.join(F.broadcast(agg), "faixa_desconto", "left").select(
        "faixa_desconto",
        X.band_order("faixa_desconto", labels).alias("ordem"),
        F.coalesce("total_itens", F.lit(0).cast("long")).alias("total_itens"),
        F.coalesce("receita_liquida", zero).alias("receita_liquida"),
        F.coalesce("desconto_total", zero).alias("desconto_total"),
        F.coalesce("margem_total", zero).alias("margem_total"),
    )
    return out.withColumn("margem_pct", X.safe_ratio("margem_total", "receita_liquida"))


def geo_performance(
    sales: DataFrame, clients: DataFrame, potential: DataFrame, months: int | Column = P.HORIZON_MONTHS
) -> DataFrame:
    """By (state, region): net, margin, distinct clients/orders, margin %, potential x months, share."""
    # pre-aggregate to one row per (client, order) before the join, so a hot
    # client no longer drags its raw lines through the join exchange
    per_order = (
        sales.groupBy("cliente_id", "pedido_id")
        .agg(
            X.money_sum("receita_liquida").alias("receita_liquida"),
            X.money_sum("margem_contribuicao").alias("margem_contribuicao"),
        )
    )
    geo = R.sales_with_client_geo(per_order, clients)
    agg = (
        geo.where(F.col("uf").isNotNull() & F.col("regiao_comercial").isNotNull())
        .groupBy("uf", "regiao_comercial")
        .agg(
            X.money_sum("receita_liquida").alias("receita_liquida"),
            X.money_sum("margem_contribuicao").alias("margem_contribuicao"),
            F.countDistinct("cliente_id").alias("clientes_atendidos"),
            F.countDistinct("pedido_id").alias("pedidos_total"),
        )
        .withColumn("margem_pct", X.try_ratio("margem_contribuicao", "receita_liquida"))
    )
    pot = R.potential_by(potential, ["uf"], months=months, name="potencial_total")
    out = agg.join(pot, "uf", "left")
    out = out.withColumn("potencial_total", F.coalesce("potencial_total", F.lit(0).cast("decimal(38,4)")))
    return out.withColumn("share_pct", X.safe_ratio("receita_liquida", "potencial_total"))


COOC_CHUNK = 256  # categories of a basket paired at a time


def distinct_baskets(sales_with_prod: DataFrame) -> DataFrame:
    """The dictionary of category sets: ``cats`` (sorted) and ``n_pedidos``, the orders that hold just that set.

    One shuffle on the order key builds each order's set (``collect_set`` is
    partial map side, so a huge order is pre-merged per task), a second counts
    equal sets, combined map side.
    """
    per_order = (
        sales_with_prod.where(F.col("pedido_id").isNotNull() & F.col("categoria").isNotNull())
        .groupBy("pedido_id")
        .agg(F.array_sort(F.collect_set("categoria")).alias("cats"))
    )
    return per_order.groupBy("cats").agg(F.count(F.lit(1)).alias("n_pedidos"))


def category_cooccurrence(
    sales_with_prod: DataFrame, categories: DataFrame | None = None, chunk: int = COOC_CHUNK
) -> DataFrame:
    """For each ordered category pair (base, other): orders holding both, orders holding base, % of base.

    Orders only differ by their category set, so pairs are made once per
    distinct set (``distinct_baskets``, checkpointed: its rows are bounded by the
    sets, not the orders) and weighted by its orders. The categories of a set
    are paired in blocks of ``chunk``, so a row never holds more than two blocks;
    pair counts are combined map side, at most one row per pair and task. The
    grid is every sold category x every sold category (0 where two never meet);
    the diagonal is 100. ``categories`` (the catalogue, column ``categoria``), if
    given, leaves only its categories in the grid.
    """
    baskets = cut_lineage(distinct_baskets(sales_with_prod))
    blocks = F.sequence(F.lit(0), F.size("cats") - 1, F.lit(chunk))
    bases = baskets.select("n_pedidos", "cats", F.explode(blocks).alias("_i")).select(
        "n_pedidos", "cats", F.slice("cats", F.col("_i") + 1, chunk).alias("_left"), F.explode(blocks).alias("_j")
    )
    pairs = bases.select(
        "n_pedidos", F.explode("_left").alias("base"), F.slice("cats", F.col("_j") + 1, chunk).alias("_right")
    ).select("n_pedidos", "base", F.explode("_right").alias("other"))
    counts = pairs.groupBy("base", "other").agg(F.sum("n_pedidos").alias("n"))
    per_base = counts.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("other", "n"))).alias("_m"))
    domain = D.domain_array(baskets.select(F.explode("cats").alias("categoria")), "categoria")
    if categories is not None:
        domain = F.array_intersect(domain, D.domain_array(categories, "categoria"))
    out = per_base.select("base", F.explode(domain).alias("other"), "_m").select(
        "base",
        "other",
        F.coalesce(F.try_element_at("_m", F.col("other")), F.lit(0).cast("long")).alias("n_pedidos_ambos"),
        F.try_element_at("_m", F.col("base")).alias("n_pedidos_base"),
    )
    return out.withColumn("pct", F.lit(100.0) * X.dbl("n_pedidos_ambos") / X.dbl("n_pedidos_base"))
