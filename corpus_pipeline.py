"""Corpus pipeline: raw documents to token ids in five stages.

Each stage works on all that its predecessor kept, written as Parquet and read
again. ``run`` applies them to the documents table; the written tables lie in
the shared folder of ``spark.checkpoint.dir``. Null texts count as empty and go
in the first stage, null ids stay; texts are taken whole; of equal texts, and of
rows repeated, one stays; an empty table gives no rows; further columns are
carried through to the last stage, which reads id and text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from storelens.llm import bpe, exact_dedup, langid, minhash, mixing
from storelens.session import remove_shared, shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or between two languages go."""
    return langid.keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document taken twice is two rows."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes decoded from them."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("minhash_dedup", near_copies),
    ("mix_sources", mix),
    ("bpe", tokens),
]

#: Signatures, language models and the knapsack are not SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    A stage's table is removed once its successor is written. The last one's
    input stays, as the result is read from it: it goes with the shared folder.
    """
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove_shared(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
