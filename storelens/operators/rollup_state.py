"""Mergeable client rollup: a state per month, updated month by month.

The state holds the lines summed to (client, order, SKU), a folder per month.
New or corrected lines of some months rewrite the folders of these months only
(dynamic partition overwrite); the client rollup merges the sums, minima,
maxima and distinct orders and SKUs of all months without reading a line again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rollups as R

MONTH = "mes_ref"
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def month_state(sales: DataFrame) -> DataFrame:
    """The lines of each (month, client, order, SKU) summed. Lines without a client are in no rollup and left out."""
    return (
        sales.where(F.col("cliente_id").isNotNull())
        .groupBy(MONTH, "cliente_id", "pedido_id", "sku_id")
        .agg(*R._line_sums())
    )


def write_state(sales: DataFrame, path: str) -> T.StructType:
    """The whole state written anew; gives the schema to read it with."""
    state = month_state(sales)
    _write(state, path, "static")
    return state.schema


def update_months(sales: DataFrame, months: Iterable[str | None], path: str) -> list[str]:
    """Replace the state of ``months`` by what ``sales`` now holds for them; other months stay untouched.

    ``sales`` may hold any months (the filter on the month is pushed into its
    scan where the source allows). A month without lines any more loses its
    folder. None stands for the lines without a month. Running it again gives
    the same state; a run that fails is run again. Gives the months emptied.
    """
    months = list(dict.fromkeys(months))
    wanted = F.col(MONTH).isin([m for m in months if m is not None])
    if None in months:
        wanted = F.coalesce(wanted, F.lit(False)) | F.col(MONTH).isNull()
    spark = sales.sparkSession
    before = {m: _files(spark, path, m) for m in months}
    _write(month_state(sales.where(wanted)), path, "dynamic")
    # a month whose files are still the old ones got no rows
    emptied = [m for m in months if before[m] and _files(spark, path, m) == before[m]]
    for m in emptied:
        _folder(spark, path, m)[0].delete(_folder(spark, path, m)[1], True)
    return emptied


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def client_sales_from_state(state: DataFrame) -> DataFrame:
    """The rows of ``rollups.client_sales``, merged from the state."""
    return state.groupBy("cliente_id").agg(*R._client_sums_of_sums())


def _write(state: DataFrame, path: str, mode: str) -> None:
    # ranged by month and client: a task writes few months, a large month is split over tasks
    (
        state.repartitionByRange(MONTH, "cliente_id", "pedido_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy(MONTH)
        .parquet(path)
    )


def _folder(spark: SparkSession, path: str, month: str | None):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path, f"{MONTH}={NO_MONTH if month is None else month}")
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _files(spark: SparkSession, path: str, month: str | None) -> list[str]:
    fs, folder = _folder(spark, path, month)
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
