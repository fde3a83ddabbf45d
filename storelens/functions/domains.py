"""Helpers for the domains of dimensions (bands, months, categories, clusters).

Scaffolds ("every client x every month", "every band x every visit type")
are generated with ``explode`` over a literal array instead of a cross join.
The domain is either a fixed parameter (band labels) or a data-derived
domain computed by a scalar subquery (no driver round-trip, no join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def with_domain(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Each row of ``df`` repeated once per value of a bounded domain (a generate, not a join)."""
    return df.withColumn(name, F.explode(literal_array(values)))


def domain_array(df: DataFrame, column: str) -> Column:
    """The sorted distinct non-null values of ``column`` as one array value.

    A scalar subquery: computed once, lazily (no extra job, no join). Its size
    is the domain's, whatever that is: use it for the attribute list of a
    dimension (categories, months, clusters), which the scaffold's output
    repeats for every row anyway.
    """
    vals = df.select(column).where(F.col(column).isNotNull()).distinct()
    return vals.agg(F.array_sort(F.collect_list(column))).scalar()


def explode_domain(df: DataFrame, domain: Column, name: str) -> DataFrame:
    """Each row of ``df`` repeated once per value of a domain array (a generate, not a join)."""
    return df.withColumn(name, F.explode(domain))


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct value (scalar subquery).

    Project it into ONE column (``withColumn("_x", one_row(agg))``) and read
    its fields from that column: every separate use of the returned Column is
    planned as its own subquery.
    """
    return df.select(F.struct(*df.columns)).scalar()
