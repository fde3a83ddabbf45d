"""Helpers shared by the operators of this package."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from storelens.session import cut_lineage, write_shared

#: A word: a run of characters other than ASCII white space (fixed value, used in Java and Python patterns alike).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name, read by Spark only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and nothing else (``lower`` equals that on pure ASCII text and is faster)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def text_or_empty(c: Column | str) -> Column:
    """A text column with null as the empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def by_content(docs: DataFrame) -> Column:
    """An order of rows by a hash of all their columns (maps, which have no order, left out), the same on every run."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])


def _few_files(df: DataFrame, per_core: int) -> DataFrame:
    """``df`` in ``per_core`` partitions a core of the cluster at most: every core still has work, and files stay few."""
    return df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism)


def checkpointed(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` checkpointed in the shared folder; the files go with the frame."""
    return cut_lineage(_few_files(df, per_core))


def written(df: DataFrame, per_core: int = 2) -> DataFrame:
    """``df`` as a table in the shared folder, which the enclosing ``shared_scope`` removes."""
    return write_shared(_few_files(df, per_core), "step")
