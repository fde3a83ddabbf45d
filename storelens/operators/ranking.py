"""Ranking, running sums, top-N, recent-month history, category mix, paging."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import domains as D
from ..functions import exprs as X
from ..functions.ordering import ROWS_PER_RANGE, range_count
from ..session import cut_lineage, write_shared


def abc_curve(
    skus: DataFrame,
    revenue: str = "receita_total",
    key: str = "sku_id",
    cuts: Sequence[float] = P.ABC_CUTS,
    labels: Sequence[str] = P.ABC_LABELS,
    n_ranges: int | None = None,
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """ABC class from the running share of revenue in (revenue desc, key asc) order.

    A global running sum would pull every row into one task. Instead:
    1. range-partition by the sort order into ``n_ranges`` slices (default: about
       ``rows_per_range`` SKUs each) and checkpoint
       (range bounds come from sampling, so both passes must see one layout);
    2. sum each slice (<= n_ranges rows) and take an exclusive prefix of those
       sums (a window over at most n_ranges rows);
    3. running sum inside each slice, plus its slice offset.
    Sums are exact decimals, so the result equals the single-window one. Ties
    are broken by ``key``; the class is A while share <= cuts[0], B while
    <= cuts[1], else C (a zero total gives NULL share → C).
    """
    n = n_ranges
    if n is None:
        # the SKU rows are written once so the count and the ranging read them
        # instead of re-running their rollup
        skus = cut_lineage(skus)
        n = range_count(skus.count(), rows_per_range)
    order = [F.desc("_rev"), F.asc(key)]
    ranged = (
        skus.withColumn("_rev", F.col(revenue).cast("decimal(38,4)"))
        .repartitionByRange(n, *order)
        .withColumn("_pid", F.spark_partition_id())
    )
    ranged = cut_lineage(ranged)
    sums = ranged.groupBy("_pid").agg(F.sum("_rev").alias("_psum"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    offsets = sums.select(
        "_pid",
        F.coalesce(F.sum("_psum").over(before), F.lit(0).cast("decimal(38,4)")).alias("_offset"),
        F.sum("_psum").over(everything).alias("_total"),
    )
    within = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumn("_run", F.sum("_rev").over(within)).join(F.broadcast(offsets), "_pid")
    out = out.withColumn("receita_cum", F.col("_offset") + F.col("_run"))
    out = out.withColumn("receita_cum_pct", X.try_ratio("receita_cum", "_total"))
    share = F.col("receita_cum_pct")
    out = out.withColumn(
        "curva_abc",
        F.when(share <= cuts[0], F.lit(labels[0])).when(share <= cuts[1], F.lit(labels[1])).otherwise(F.lit(labels[2])),
    )
    return out.drop("_rev", "_pid", "_run", "_offset", "_total")


def client_top_skus(sales: DataFrame, n: int = P.TOP_SKUS) -> DataFrame:
    """Top-n SKUs per client by summed net revenue (ties: lower sku_id first); long form with rank."""
    per = (
        sales.where(F.col("cliente_id").isNotNull() & F.col("sku_id").isNotNull())
        .groupBy("cliente_id", "sku_id")
        .agg(X.money_sum("receita_liquida").alias("receita_liquida"))
    )
    w = Window.partitionBy("cliente_id").orderBy(F.desc("receita_liquida"), F.asc("sku_id"))
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_skus_nested(top: DataFrame) -> DataFrame:
    """``cliente_id, top_skus: array<struct<rank, sku_id, receita_liquida>>`` ordered by rank."""
    return top.groupBy("cliente_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "sku_id", "receita_liquida"))).alias("top_skus")
    )


def recent_months(sales: DataFrame, n: int = P.SPARKLINE_MONTHS) -> DataFrame:
    """The last ``n`` distinct months (a top-n), one row each."""
    return sales.select("mes_ref").where(F.col("mes_ref").isNotNull()).distinct().orderBy(F.desc("mes_ref")).limit(n)


def _values_by_key(per: DataFrame, key: str) -> DataFrame:
    """``cliente_id, _m: map<key, receita_liquida>`` (one entry per key the client has, at most the domain)."""
    return per.groupBy("cliente_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "receita_liquida"))).alias("_m"))


def _scaffold(clients: DataFrame, per_client: DataFrame, domain, key: str) -> DataFrame:
    """Every client x every domain value with its net (0 where absent).

    The clients are joined to their per-client maps on the client key alone,
    and the domain is exploded after that join: only one row per client is
    shuffled, never the clients x domain scaffold.
    """
    base = clients.select("cliente_id").join(per_client, "cliente_id", "left")
    out = base.select("cliente_id", F.explode(domain).alias(key), "_m")
    net = F.coalesce(F.try_element_at("_m", F.col(key)), F.lit(0).cast("decimal(38,4)"))
    return out.select("cliente_id", key, net.alias("receita_liquida"), "_m")


def client_sparkline(clients: DataFrame, sales: DataFrame, n: int = P.SPARKLINE_MONTHS) -> DataFrame:
    """Net revenue per client for each of the last ``n`` months; every client present, zeros filled (long form)."""
    # one pass over the fact: net per (client, month), written once; the
    # month domain and the values are both read from it
    by_month = cut_lineage(
        sales.groupBy("cliente_id", "mes_ref").agg(X.money_sum("receita_liquida").alias("receita_liquida"))
    )
    months = recent_months(by_month, n)  # at most n rows
    per = by_month.join(F.broadcast(months), "mes_ref", "left_semi").where(F.col("cliente_id").isNotNull())
    out = _scaffold(clients, _values_by_key(per, "mes_ref"), D.domain_array(months, "mes_ref"), "mes_ref")
    return out.drop("_m")


def sparkline_nested(long: DataFrame, digits: int = 1) -> DataFrame:
    """``cliente_id, meses: array<string>, valores: array<double>`` in month order."""
    g = long.groupBy("cliente_id").agg(
        F.array_sort(F.collect_list(F.struct("mes_ref", X.round_money("receita_liquida", digits).alias("v")))).alias(
            "_s"
        )
    )
    return g.select("cliente_id", F.col("_s.mes_ref").alias("meses"), F.col("_s.v").alias("valores"))


def client_category_mix(clients: DataFrame, sales_with_prod: DataFrame, products: DataFrame) -> DataFrame:
    """Net revenue per client for every catalogue category, zeros filled, plus bar share and bought flag.

    Bar share = value / greatest(client's max value, 100) x 100, capped at 100.
    """
    per = (
        sales_with_prod.where(F.col("cliente_id").isNotNull() & F.col("categoria").isNotNull())
        .groupBy("cliente_id", "categoria")
        .agg(X.money_sum("receita_liquida").alias("receita_liquida"))
    )
    out = _scaffold(clients, _values_by_key(per, "categoria"), D.domain_array(products, "categoria"), "categoria")
    # the client's largest value (absent categories count as 0), at least 100
    top = F.greatest(
        F.coalesce(F.array_max(F.map_values("_m")), F.lit(0).cast("decimal(38,4)")), F.lit(100).cast("decimal(38,4)")
    )
    return out.select(
        "cliente_id",
        "categoria",
        "receita_liquida",
        F.least(F.lit(100.0), X.dbl("receita_liquida") / X.dbl(top) * F.lit(100.0)).alias("barra_pct"),
        (F.col("receita_liquida") > 0).alias("comprado"),
    )


def mix_nested(long: DataFrame, digits: int = 1) -> DataFrame:
    """``cliente_id, mix: map<categoria, double>``."""
    return long.groupBy("cliente_id").agg(
        F.map_from_entries(F.collect_list(F.struct("categoria", X.round_money("receita_liquida", digits)))).alias("mix")
    )


def sort_key(c: str, ascending: bool) -> Column:
    return F.asc(c) if ascending else F.desc(c)


def sorted_page(
    df: DataFrame,
    key: str = "rec_liq",
    ascending: bool = False,
    page: int = 1,
    size: int = P.PAGE_SIZE,
    id_col: str = "id",
) -> DataFrame:
    """Rows of page ``page`` (1-based) in (key, id) order, with total row and page counts.

    ``orderBy.offset.limit`` plans as a bounded top-(offset+size) per task
    (TakeOrderedAndProject), never a full sort into one task.
    """
    start = (max(page, 1) - 1) * size
    rows = df.orderBy(sort_key(key, ascending), F.asc(id_col)).offset(start).limit(size)
    rows = rows.withColumn("total_linhas", df.agg(F.count(F.lit(1))).scalar())
    return rows.withColumn(
        "total_paginas", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total_linhas") / F.lit(size)).cast("long"))
    )


@dataclass
class PageDirectory:
    """A record written once in key order, in ranges, with the rows ahead of each range: any page reads its ranges only."""

    table: DataFrame
    key: str
    ascending: bool
    id_col: str
    size: int
    starts: list[int]  # rows ahead of every range, and at the end all rows

    @property
    def rows(self) -> int:
        return self.starts[-1]

    @property
    def pages(self) -> int:
        return max(1, -(-self.rows // self.size))

    def ranges_of(self, page: int) -> list[int]:
        """The ranges that hold rows of a page (from 1)."""
        first, behind = (max(page, 1) - 1) * self.size, max(page, 1) * self.size
        ends = zip(self.starts, self.starts[1:], strict=False)
        return [i for i, (at, end) in enumerate(ends) if at < behind and end > first]

    def page(self, page: int) -> DataFrame:
        """Rows of a page in (key, id) order with ``total_linhas`` and ``total_paginas``; only its ranges are read."""
        ranges = self.ranges_of(page)
        skip = (max(page, 1) - 1) * self.size - (self.starts[ranges[0]] if ranges else 0)
        mine = self.table.where(F.col("_range").isin(ranges)) if ranges else self.table.where(F.lit(False))
        rows = mine.drop("_range").orderBy(sort_key(self.key, self.ascending), F.asc(self.id_col))
        rows = rows.offset(skip).limit(self.size) if ranges else rows
        return rows.withColumns(
            {"total_linhas": F.lit(self.rows).cast("long"), "total_paginas": F.lit(self.pages).cast("long")}
        )


def page_directory(
    df: DataFrame,
    key: str = "rec_liq",
    ascending: bool = False,
    size: int = P.PAGE_SIZE,
    id_col: str = "id",
    rows_per_range: int = ROWS_PER_RANGE,
) -> PageDirectory:
    """Write ``df`` in ranges of (key, id) order and count them, so that deep pages cost no more than the first.

    The rows are counted and ranged from a checkpoint, then written partitioned
    by range; one count per range (rows / ``rows_per_range``) reaches the driver.
    Within a ``shared_scope`` the table goes when the block ends. Equal keys of
    one id stay in some order; a null key sorts as in ``orderBy``.
    """
    order = [sort_key(key, ascending), F.asc(id_col)]
    df = cut_lineage(df)
    n = range_count(df.count(), rows_per_range)
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    table = write_shared(ranged, "pages", partition_by="_range")
    counts = {r["_range"]: r["n"] for r in table.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = [0, *itertools.accumulate(counts.get(i, 0) for i in range(n))]
    return PageDirectory(table, key, ascending, id_col, size, starts)


def first_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cluster_ranking(profile: DataFrame, cluster_col: str = "cluster_raw") -> DataFrame:
    """Cluster ranks (1 = highest) by mean revenue, mean recency, mean checkouts, mean discount.

    The profile has one row per cluster (k rows), so the global windows here
    run over k rows.
    """
    out = profile.select(cluster_col, "rec_liq_med", "recencia_med", "checkouts_med", "desconto_pct_med")
    for metric, name in (
        ("rec_liq_med", "rank_receita"),
        ("recencia_med", "rank_recencia"),
        ("checkouts_med", "rank_checkouts"),
        ("desconto_pct_med", "rank_desconto"),
    ):
        w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(metric), F.asc(cluster_col))
        out = out.withColumn(name, F.row_number().over(w))
    return out.select(cluster_col, "rank_receita", "rank_recencia", "rank_checkouts", "rank_desconto")
