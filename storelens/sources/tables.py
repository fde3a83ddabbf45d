"""Reading input tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_names(raw: Iterable[str | None]) -> list[str]:
    """Column names from a header row; an empty cell becomes ``col_{idx}``."""
    return [str(c) if c is not None and str(c) != "" else f"col_{i}" for i, c in enumerate(raw)]


def unique_names(names: Iterable[str]) -> list[str]:
    """The first column of a name keeps it, a later one gets ``_2``, ``_3``, ... (upper and lower case are the same name)."""
    names = list(names)
    taken, out = {n.lower() for n in names}, []
    seen: set[str] = set()
    for name in names:
        new, k = name, 1
        while new.lower() in seen or (k > 1 and new.lower() in taken):
            k += 1
            new = f"{name}_{k}"
        seen.add(new.lower())
        out.append(new)
    return out


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    fmt: str | None = None,
) -> DataFrame:
    """Read one named table (parquet by default, CSV with a header row).

    With a schema, only its columns are read (the scan is pruned to them) and
    each is cast to its declared type; ``try_cast`` turns unparseable text into
    NULL instead of failing under ANSI mode. Unnamed CSV columns get
    ``col_{idx}`` names.
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
        df = df.toDF(*header_names([None if c.startswith("_c") else c for c in df.columns]))
    else:
        df = spark.read.parquet(path)
    if schema is None:
        return df
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in present:
            c = F.col(f.name)
            cols.append((c if df.schema[f.name].dataType == f.dataType else c.try_cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Listed columns to double; text that is not a number becomes NULL."""
    cols = list(cols)
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})


CORRUPT = "_registro_malformado"
REJECTS = "coluna string, motivo string, valor string"
BAD_TYPE, BAD_RECORD = "tipo", "registro"


@dataclass(frozen=True)
class CheckedTable:
    """A table read to a schema, and what was lost on the way.

    ``rows`` as ``load_table`` gives them. ``rejects`` has a row per cell that
    holds something but not a value of its type (``motivo`` tipo), and per CSV
    record with too few or too many cells (``motivo`` registro, ``valor`` the
    whole record; its cells are read as far as they go). ``missing`` are columns
    of the schema that the file does not have.
    """

    rows: DataFrame
    rejects: DataFrame
    missing: tuple[str, ...]

    def counts(self) -> DataFrame:
        """``coluna, motivo, n, menor_valor``: rejects per column and reason, with the smallest rejected text."""
        return self.rejects.groupBy("coluna", "motivo").agg(
            F.count(F.lit(1)).alias("n"), F.min("valor").alias("menor_valor")
        )


def load_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None) -> CheckedTable:
    """``load_table`` that shows its rejects instead of turning bad cells into NULL unseen.

    Both frames are lazy and scan the file once each. CSV: only the header row
    reaches the driver; of two columns with one name the second is read as
    ``name_2``. Empty cells are NULL, not rejects.
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        first = spark.read.option("header", False).csv(path).first()
        names = unique_names(header_names(first or []))
        text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
        raw = (
            spark.read.schema(text)
            .option("header", True)
            .option("enforceSchema", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False)  # a record's cells are counted whichever columns are asked for
            .csv(path)
        )
    else:
        raw = spark.read.parquet(path).withColumn(CORRUPT, F.lit(None).cast("string"))
        names = raw.columns[:-1]
    present = set(names)
    cols, checks = [], []
    for f in schema.fields:
        if f.name not in present:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c, kind = F.col(f"`{f.name}`"), raw.schema[f.name].dataType
        value = c if kind == f.dataType else c.try_cast(f.dataType)
        cols.append(value.alias(f.name))
        if kind != f.dataType:
            checks.append((c.isNotNull() & value.isNull(), f.name, BAD_TYPE, c.cast("string")))
    checks.append((F.col(CORRUPT).isNotNull(), None, BAD_RECORD, F.col(CORRUPT)))
    cells = F.array(
        *[
            F.when(bad, F.struct(F.lit(name).cast("string").alias("coluna"), F.lit(why).alias("motivo"), v.alias("valor")))
            for bad, name, why, v in checks
        ]
    )
    rejects = raw.select(F.inline(F.filter(cells, lambda x: x.isNotNull())))
    missing = tuple(f.name for f in schema.fields if f.name not in present)
    return CheckedTable(raw.select(*cols), rejects, missing)
