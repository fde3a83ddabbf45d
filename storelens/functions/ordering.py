"""Global ranks without a global window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


#: Rows of a range, about: the number of ranges follows the rows alone.
ROWS_PER_RANGE = 1_000_000


def range_count(rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    return max(1, -(-rows // rows_per_range))


def global_rank(
    df: DataFrame, order: Sequence[str], name: str, rows_per_range: int = ROWS_PER_RANGE, dtype: str = "int"
) -> DataFrame:
    """``df`` with ``name``, the rank from 1 in ascending ``order`` (``dtype`` long for keys beyond 2^31).

    The rows are written and counted, range-partitioned and checkpointed (range bounds come from
    sampling, so counting and numbering must see one layout), numbered inside
    their range, and shifted by the sizes of the ranges before: the only window
    over everything has one row per range.
    """
    df = cut_lineage(df)
    n = range_count(df.count(), rows_per_range)
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_nth", F.row_number().over(inside))
        .join(starts, "_range")
        .withColumn(name, (F.col("_start") + F.col("_nth")).cast(dtype))
        .drop("_range", "_nth", "_start")
    )
