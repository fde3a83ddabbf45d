"""Interactive exploration over saved master tables: filters, search, filtered KPIs, cards, 360 view."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import exprs as X
from ..functions.ordering import global_rank

ALL = "ALL"


@dataclass(frozen=True)
class FilterSpec:
    """Up to six equality filters; ``ALL`` (or None) means no constraint on that dimension."""

    canal: str | None = ALL
    uf: str | None = ALL
    regiao: str | None = ALL
    porte: str | None = ALL
    cluster: int | str | None = ALL
    vendedor: int | str | None = ALL
    search: str = ""

    COLUMNS = {
        "canal": "canal",
        "uf": "uf",
        "regiao": "regiao_comercial",
        "porte": "porte",
        "cluster": "cluster_raw",
        "vendedor": "vendedor_id",
    }

    def constraints(self) -> dict[str, object]:
        out = {}
        for field, col in self.COLUMNS.items():
            v = getattr(self, field)
            if v is not None and v != ALL:
                out[col] = v
        return out

    def predicate(self, columns: Sequence[str] | None = None) -> Column:
        cond = F.lit(True)
        for col, v in self.constraints().items():
            if columns is not None and col not in columns:
                continue
            c = F.col(col)
            cond = cond & (c.cast("string") == F.lit(str(v)) if col in ("cluster_raw", "vendedor_id") else c == F.lit(v))
        return cond

    @property
    def active(self) -> bool:
        return bool(self.constraints())


def dimension_filter(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Clients that satisfy every active equality filter."""
    return df.where(spec.predicate(df.columns))


def filter_counts(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row: clients kept by the filter and clients in total."""
    return df.agg(
        X.count_if(spec.predicate(df.columns)).alias("n_filtrados"), F.count(F.lit(1)).alias("n_total")
    )


def search_condition(q: str, cols: Sequence[str]) -> Column:
    """Case-insensitive substring match of the trimmed query over any of ``cols``."""
    needle = q.strip().lower()
    if not needle:
        return F.lit(True)
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(F.col(c).cast("string")).contains(F.lit(needle)), F.lit(False))
    return cond


def text_search(df: DataFrame, q: str, cols: Sequence[str]) -> DataFrame:
    return df.where(search_condition(q, cols))


CLIENT_SEARCH_COLS = ("nome", "id", "cidade", "uf", "vendedor_id")
PRODUCT_SEARCH_COLS = ("nome", "sku_id", "categoria")


def search_clients(record: DataFrame, q: str, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Client records kept by the filter and matching the search text."""
    spec_cols = {"regiao_comercial": "regiao"}
    cond = F.lit(True)
    for col, v in spec.constraints().items():
        c = spec_cols.get(col, col)
        cond = cond & (F.col(c).cast("string") == F.lit(str(v)))
    return record.where(cond & search_condition(q, CLIENT_SEARCH_COLS))


def search_products(record: DataFrame, q: str) -> DataFrame:
    return record.where(search_condition(q, PRODUCT_SEARCH_COLS))


def search_flag(record: DataFrame, q: str, spec: FilterSpec) -> DataFrame:
    """Mark, don't drop: does name/id/city match the search, and is the client inside the filter."""
    spec_cols = {"regiao_comercial": "regiao"}
    inside = F.lit(True)
    for col, v in spec.constraints().items():
        inside = inside & (F.col(spec_cols.get(col, col)).cast("string") == F.lit(str(v)))
    match = search_condition(q, ("nome", "id", "cidade")) if q.strip() else F.lit(False)
    return record.select("id", match.alias("destaque_busca"), inside.alias("no_filtro"))


def distinct_values(df: DataFrame, col: str, order_by: str | None = None, label: str | None = None) -> DataFrame:
    """Sorted distinct values of a column (``dimensao, valor, ordem``)."""
    order_by = order_by or col
    base = df.select(F.col(col).cast("string").alias("valor"), F.col(order_by).alias("_o")).where(
        F.col("valor").isNotNull()
    ).distinct()
    return global_rank(base, ["_o", "valor"], "ordem").select(F.lit(label or col).alias("dimensao"), "valor", "ordem")


def kpis_filtered(master: DataFrame, spec: FilterSpec) -> DataFrame:
    """KPI row re-derived from the filtered client rollup (orders are summed over clients; active = net > 0)."""
    f = dimension_filter(master, spec)
    a = f.agg(
        X.money_sum("receita_liquida").alias("rec"),
        X.money_sum("receita_bruta").alias("bruta"),
        X.money_sum("desconto_total").alias("desc"),
        X.money_sum("margem_total").alias("marg"),
        F.coalesce(F.sum("total_pedidos"), F.lit(0)).cast("long").alias("pedidos"),
        X.count_if(F.col("receita_liquida") > 0).alias("ativos"),
        F.count(F.lit(1)).alias("clientes"),
    )
    return kpi_row(a)


def kpi_row(a: DataFrame) -> DataFrame:
    """KPI columns from the sums ``rec, bruta, desc, marg, pedidos, ativos, clientes``."""
    return a.select(
        X.dbl("rec").alias("receita_liquida"),
        X.dbl("bruta").alias("receita_bruta"),
        X.dbl("desc").alias("desconto_total"),
        X.dbl("marg").alias("margem_total"),
        "pedidos",
        "ativos",
        "clientes",
        (X.safe_ratio("marg", "rec") * 100).alias("margem_pct"),
        (X.safe_ratio("desc", "bruta") * 100).alias("desconto_pct"),
        X.safe_ratio("rec", "pedidos").alias("ticket_medio"),
        (X.safe_ratio("ativos", "clientes") * 100).alias("taxa_ativacao"),
    )


def cluster_cards(master: DataFrame, spec: FilterSpec, cluster_col: str = "cluster_raw") -> DataFrame:
    """Per cluster (all clusters present): clients inside the filter, their share of the filtered count, revenue."""
    f = dimension_filter(master, spec)
    per = f.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("n_clientes"), X.money_sum("receita_liquida").alias("receita_liquida")
    )
    n_all = f.agg(F.count(F.lit(1))).scalar()
    clusters = master.select(cluster_col).where(F.col(cluster_col).isNotNull()).distinct()
    return card_rows(clusters, per, n_all, cluster_col)


def card_rows(clusters: DataFrame, per: DataFrame, n_all: Column, cluster_col: str) -> DataFrame:
    """A card per cluster from its ``n_clientes`` and ``receita_liquida`` inside the filter (none: 0)."""
    out = clusters.join(per, cluster_col, "left").withColumn("_nf", n_all)
    out = out.withColumns(
        {
            "n_clientes": F.coalesce("n_clientes", F.lit(0).cast("long")),
            "receita_liquida": F.coalesce("receita_liquida", F.lit(0).cast("decimal(38,4)")),
        }
    )
    return out.select(
        cluster_col, "n_clientes", (X.safe_ratio("n_clientes", "_nf") * 100).alias("pct_filtro"), "receita_liquida"
    )


def crosstab_counts(df: DataFrame, row: str, col: str, col_values: Sequence, prefix: str) -> DataFrame:
    """Counts of ``row`` x ``col`` for a given column domain, one column per value, 0-filled."""
    piv = df.where(F.col(row).isNotNull()).groupBy(row).pivot(col, list(col_values)).count()
    return piv.select(
        row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0).cast("long")).alias(f"{prefix}{v}") for v in col_values]
    )


def count_by(df: DataFrame, col: str, domain: Sequence | None = None, name: str = "n") -> DataFrame:
    """Rows per value of ``col``; with a domain, every domain value is present (absent → 0).

    With a domain, only its values are counted, so the broadcast counts have at
    most one row per domain value.
    """
    rows = df.where(F.col(col).isNotNull())
    if domain is not None:
        rows = rows.where(F.col(col).isin(list(domain)))
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if domain is None:
        return counts
    grid = D.with_domain(df.sparkSession.range(1), col, list(domain)).select(col)
    return grid.join(F.broadcast(counts), col, "left").select(col, F.coalesce(name, F.lit(0).cast("long")).alias(name))


def category_revenue(skus: DataFrame) -> DataFrame:
    """Revenue per category, descending."""
    return (
        skus.where(F.col("categoria").isNotNull())
        .groupBy("categoria")
        .agg(X.money_sum("receita_total").alias("receita_total"))
        .orderBy(F.desc("receita_total"), F.asc("categoria"))
    )


def client_360(
    record: DataFrame, mix_long: DataFrame, top_long: DataFrame, products: DataFrame, seller_rec: DataFrame, spark_long: DataFrame
) -> DataFrame:
    """Full per-client record: master fields + category mix map + named top SKUs + rep scorecard + sparkline.

    All inputs are keyed by client (or rep); every join is a left join, so a
    missing rep leaves only its id. Filtering one client pushes below the joins.
    """
    mix = mix_long.groupBy("cliente_id").agg(
        F.map_from_entries(F.collect_list(F.struct("categoria", X.dbl("receita_liquida")))).alias("mix"),
        X.count_if(F.col("comprado")).alias("categorias_compradas"),
    )
    top = top_long.join(products.select("sku_id", "sku_nome"), "sku_id", "left").groupBy("cliente_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "sku_id", F.coalesce("sku_nome", F.col("sku_id").cast("string")).alias("nome"), X.dbl("receita_liquida").alias("receita_liquida")))
        ).alias("top_skus")
    )
    spk = spark_long.groupBy("cliente_id").agg(
        F.array_sort(F.collect_list(F.struct("mes_ref", X.dbl("receita_liquida").alias("v")))).alias("_s")
    ).select("cliente_id", F.col("_s.mes_ref").alias("meses"), F.col("_s.v").alias("sparkline"))
    rep = seller_rec.select(
        F.col("id").alias("vendedor_id"),
        F.col("nome").alias("vendedor_nome"),
        F.col("regiao").alias("vendedor_regiao"),
        F.col("ating_rec_pct").alias("vendedor_ating_rec_pct"),
    )
    base = record.withColumnRenamed("id", "cliente_id")
    return (
        base.join(mix, "cliente_id", "left")
        .join(top, "cliente_id", "left")
        .join(spk, "cliente_id", "left")
        .join(rep, "vendedor_id", "left")
    )
