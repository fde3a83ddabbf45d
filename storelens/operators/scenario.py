"""What-if scenario sweep: a table of lever settings evaluated against aggregates of the fact.

Levers (per scenario row): ``corte_desconto_pp`` (discount cut, p.p. of gross),
``reativacao_pct`` (share of inactive clients reactivated), ``cross_sell_pct``
(revenue growth of the high-potential segment), ``ganho_conversao_pct``
(visit-conversion gain). Base quantities come from the data: gross, net and
margin totals, the number of clients that never bought, and the revenue of
the high-potential segment; per-client ticket, the route share and the
margins are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import domains as D
from ..functions import exprs as X


def scenario_base(master: DataFrame, high_potential_flag: str | None = "is_high_potential", by: Sequence[str] = ()) -> DataFrame:
    """Base aggregates (optionally per group): gross, net, margin, inactive clients, high-potential revenue."""
    hp = F.col(high_potential_flag) if high_potential_flag else F.lit(False)
    aggs = [
        X.money_sum("receita_bruta").alias("base_bruta"),
        X.money_sum("receita_liquida").alias("base_receita"),
        X.money_sum("margem_total").alias("base_margem"),
        X.count_if(F.col("total_pedidos") == 0).alias("clientes_inativos"),
        X.money_sum(F.when(hp, F.col("receita_liquida"))).alias("receita_alto_potencial"),
    ]
    return master.groupBy(*by).agg(*aggs) if by else master.agg(*aggs)


def scenario_sweep(
    scenarios: DataFrame,
    base: DataFrame,
    by: Sequence[str] = (),
    churn_ticket: float = P.SCENARIO_CHURN_TICKET,
    churn_margin: float = P.SCENARIO_CHURN_MARGIN,
    cross_margin: float = P.SCENARIO_CROSS_SELL_MARGIN,
    route_share: float = P.SCENARIO_ROUTE_SHARE,
    route_margin: float = P.SCENARIO_ROUTE_MARGIN,
) -> DataFrame:
    """Added revenue, added margin, new margin % and its change in p.p. for every scenario (x every group)."""
    if by:
        # one base row per group: scenarios carry the group key (equi-join)
        j = scenarios.join(base, on=list(by), how="inner")
    else:
        j = scenarios.withColumn("_base", D.one_row(base))
        j = j.withColumns({c: F.col(f"_base.{c}") for c in base.columns}).drop("_base")
    g, r, m = X.dbl("base_bruta"), X.dbl("base_receita"), X.dbl("base_margem")
    lit = F.lit
    ganho_desc = g * (X.dbl("corte_desconto_pp") / lit(100.0))
    rec_churn = X.dbl("clientes_inativos") * (X.dbl("reativacao_pct") / lit(100.0)) * lit(float(churn_ticket))
    rec_cross = X.dbl("receita_alto_potencial") * (X.dbl("cross_sell_pct") / lit(100.0))
    rec_rotas = (X.dbl("ganho_conversao_pct") / lit(100.0)) * (r * lit(float(route_share)))
    rec_inc = rec_churn + rec_cross + rec_rotas
    marg_inc = ganho_desc + rec_churn * lit(float(churn_margin)) + rec_cross * lit(float(cross_margin)) + rec_rotas * lit(float(route_margin))
    out = j.withColumns({"receita_incremental": rec_inc, "margem_incremental": marg_inc})
    out = out.withColumns(
        {
            "receita_incremental_pct": X.try_ratio("receita_incremental", r) * lit(100.0),
            "nova_margem_pct": X.try_ratio(m + F.col("margem_incremental"), r + F.col("receita_incremental")) * lit(100.0),
        }
    )
    out = out.withColumn("delta_margem_pp", F.col("nova_margem_pct") - X.try_ratio(m, r) * lit(100.0))
    return out
