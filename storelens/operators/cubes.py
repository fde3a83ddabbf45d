"""Filter cube: the answer to every selection of the six dimensions, aggregated once.

``filter_cube`` first sums the clients to the distinct combinations of the six
dimensions, then to all 64 grouping sets of them, in exact decimals. The cube
is written partitioned by grouping set; a selection names its set (the
dimensions it fixes, and those it lists) and reads that folder alone, so an
interactive filter costs a lookup instead of a pass over the clients.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import write_shared
from .explore import FilterSpec, card_rows, kpi_row

DIMENSIONS = tuple(FilterSpec.COLUMNS.values())
SET = "conjunto"
MONEY = {"rec": "receita_liquida", "bruta": "receita_bruta", "desc": "desconto_total", "marg": "margem_total"}
COUNTS = ("pedidos", "ativos", "clientes")


def grouping_set(kept: Sequence[str], dims: Sequence[str] = DIMENSIONS) -> int:
    """Number of the grouping set that keeps ``kept``: a bit for each other dimension, the first one the highest."""
    unknown = set(kept) - set(dims)
    if unknown:
        raise ValueError(f"not a dimension of the cube: {sorted(unknown)}")
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)


def filter_cube(master: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """``conjunto``, the dimensions (NULL where summed over) and the sums behind the KPIs, per grouping set.

    A NULL dimension value is a value of its own: its rows count in every set
    that sums over the dimension, and no equality filter finds them. No clients
    give no rows, which every lookup reads as zeros.
    """
    base = master.groupBy(*dims).agg(
        *[X.money_sum(c).alias(n) for n, c in MONEY.items()],
        F.coalesce(F.sum("total_pedidos"), F.lit(0)).cast("long").alias("pedidos"),
        X.count_if(F.col("receita_liquida") > 0).alias("ativos"),
        F.count(F.lit(1)).alias("clientes"),
    )
    return base.cube(*dims).agg(
        F.grouping_id().cast("long").alias(SET),
        *[X.money_sum(n).alias(n) for n in MONEY],
        *[F.sum(n).cast("long").alias(n) for n in COUNTS],
    ).select(SET, *dims, *MONEY, *COUNTS)


@dataclass(frozen=True)
class FilterCube:
    """A cube to be asked; ``rows`` as ``filter_cube`` gives them."""

    rows: DataFrame
    dims: tuple[str, ...] = DIMENSIONS

    def lookup(self, spec: FilterSpec = FilterSpec(), by: Sequence[str] = ()) -> DataFrame:
        """Sums inside the selection: one row (none if no client is inside), or one per value of ``by``."""
        fixed = spec.constraints()
        return self.rows.where(
            (F.col(SET) == F.lit(grouping_set({*fixed, *by}, self.dims))) & spec.predicate(self.dims)
        ).select(*by, *MONEY, *COUNTS)

    def kpis(self, spec: FilterSpec = FilterSpec()) -> DataFrame:
        """The row of ``explore.kpis_filtered``."""
        found = self.lookup(spec).agg(
            *[X.money_sum(n).alias(n) for n in MONEY],
            *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in COUNTS],
        )
        return kpi_row(found)

    def counts(self, spec: FilterSpec) -> DataFrame:
        """The row of ``explore.filter_counts``."""
        inside, total = self.lookup(spec).agg(F.sum("clientes")), self.lookup().agg(F.sum("clientes"))
        zero = F.lit(0)
        return self.rows.sparkSession.range(1).select(
            F.coalesce(inside.scalar(), zero).cast("long").alias("n_filtrados"),
            F.coalesce(total.scalar(), zero).cast("long").alias("n_total"),
        )

    def cards(self, spec: FilterSpec, cluster_col: str = "cluster_raw") -> DataFrame:
        """The rows of ``explore.cluster_cards``."""
        clusters = self.lookup(by=[cluster_col]).select(cluster_col).where(F.col(cluster_col).isNotNull())
        per = self.lookup(spec, [cluster_col]).select(
            cluster_col, F.col("clientes").alias("n_clientes"), F.col("rec").alias("receita_liquida")
        )
        n_all = F.coalesce(self.lookup(spec).agg(F.sum("clientes")).scalar(), F.lit(0))
        return card_rows(clusters, per, n_all, cluster_col)

    def facet(self, dim: str, spec: FilterSpec = FilterSpec()) -> DataFrame:
        """Clients per value of ``dim`` under the other filters of ``spec`` (what a drop-down shows beside each value)."""
        field = next(f for f, c in FilterSpec.COLUMNS.items() if c == dim)
        others = FilterSpec(**{f: getattr(spec, f) for f in FilterSpec.COLUMNS if f != field})
        return self.lookup(others, [dim]).where(F.col(dim).isNotNull()).select(dim, "clientes")


def write_cube(master: DataFrame, dims: Sequence[str] = DIMENSIONS) -> FilterCube:
    """The cube written once to the shared folder, a subfolder per grouping set.

    Rows are ranged by set and dimensions first, so a task writes few sets and
    the files of a large set have narrow value ranges. The caller removes the
    table, or a ``shared_scope`` does.
    """
    cube = filter_cube(master, dims)
    ranged = cube.repartitionByRange(SET, *dims).sortWithinPartitions(SET, *dims)
    return FilterCube(write_shared(ranged, "filter_cube", partition_by=SET), tuple(dims))
