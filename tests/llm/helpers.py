"""Fixtures in code for the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark: SparkSession, rows: list[tuple], partitions: int = 3) -> DataFrame:
    """Documents (doc_id, text[, source[, lang]]), with extra columns whose names operators use inside."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else None, len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(partitions)
    extra = "kept size shard b nid k1 k2 rid label __t __id __name text_sha256 host html tree target".split()
    for c in extra:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
