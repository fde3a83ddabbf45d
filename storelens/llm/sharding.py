"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters fit.

Every row gets a 128-bit key, written as 32 hex digits: 64 bits of its text's
hash, then 64 bits of its id's hash. So rows with equal texts are neighbours
in key order, and a text held by a third of all rows is still divisible by id.
For all splitters at once, a round counts the bytes and rows below 256
candidate boundaries of each splitter's interval (one aggregation, at most
256 rows a splitter reach the driver) and either accepts the nearest boundary
or goes on inside the candidate that holds the target. Boundaries within
``tolerance`` of the mean shard size are taken at text granularity, so equal
texts stay together unless their group alone is too large for that.

The refinement reads a checkpointed key table without texts. Rows are then
exchanged once, by shard and a slice of the id's hash, which is even whatever
the texts are; slots are numbered in that exchange.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.llm.common import checkpointed, text_or_empty

TOLERANCE = 0.005
DIGITS = 32
GROUP_DIGITS = 16
#: Hex digits of the id's hash that divide a shard for the exchange.
SLICE_DIGITS = 3


def key_of(text: Column, id_: Column) -> Column:
    """The 32 hex digits (lower case) of the hashes of text and id."""
    digits = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit("id"), id_))]
    return F.concat(*digits)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes + 1, null text: 1), text_crc32, __key."""
    t = text_or_empty("__text")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")).select(
        "doc_id",
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        key_of(t, F.col("doc_id")).alias("__key"),
    )


def successor(prefix: str) -> str:
    """The least hex text above every text that begins with ``prefix`` ('g' if there is none)."""
    kept = prefix.rstrip("f")
    return kept[:-1] + f"{int(kept[-1], 16) + 1:x}" if kept else "g"


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """n_shards - 1 boundaries (hex prefixes): shard i holds the keys from boundary i-1 up to, not including, boundary i."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * (i + 1) / n_shards for i in range(n_shards - 1)]
    found: dict[int, str] = {}
    at = {i: ("", 0) for i in range(n_shards - 1)}  # prefix of the candidate that holds the target, bytes below it
    if not total:
        return ["g"] * (n_shards - 1)
    slack = tolerance * total / n_shards
    while at:
        prefixes = sorted({p for p, _ in at.values()})
        inside = F.lit(False)
        part = F.lit(None).cast("string")
        for p in prefixes:
            inside = inside | F.col("__key").startswith(p)
            part = F.when(F.col("__key").startswith(p), F.substring("__key", 1, len(p) + 2)).otherwise(part)
        counted = (
            keys.filter(inside)
            .groupBy(part.alias("__part"))
            .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("__key").alias("lo"), F.max("__key").alias("hi"))
            .collect()
        )  # at most 256 rows a splitter
        counted.sort(key=lambda r: r["__part"])
        for i, (prefix, below) in list(at.items()):
            edge = below
            for r in (r for r in counted if r["__part"].startswith(prefix)):
                if edge + r["b"] <= targets[i]:
                    edge += r["b"]
                    continue
                under, over = targets[i] - edge, edge + r["b"] - targets[i]
                common = os.path.commonprefix([r["lo"], r["hi"]])
                common = common[: len(common) // 2 * 2]
                if min(under, over) <= slack or r["n"] == 1 or len(common) >= DIGITS:
                    found[i] = r["lo"] if under <= over else successor(r["hi"])
                    del at[i]
                else:
                    # one text only: next the ids of its rows
                    at[i] = (common if len(common) < DIGITS else r["lo"], edge)
                break
            else:
                found[i] = successor(prefix) if prefix else "g"
                del at[i]
    return [found[i] for i in range(n_shards - 1)]


def shard_of(splitters: list[str]):
    """Column: the shard of ``__key``."""
    out = F.lit(0)
    for s in splitters:
        out = out + (F.col("__key") >= F.lit(s)).cast("int")
    return out


def assign_shards(
    docs: DataFrame, n_shards: int = 8, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Shards get near equal bytes: each boundary lies within ``tolerance`` of the
    mean shard size from its target, or as near as one row allows. Slots run
    from 0 without gaps in every shard. Null texts have size 1, and a null id
    is an id of its own. Rows with the same id and text are tied: they share a
    shard, and their slots are in no defined order. An empty table gives no
    rows. Other columns are not read.
    """
    keys = checkpointed(keyed(docs, id_col, text_col))
    placed = keys.withColumn("shard", shard_of(find_splitters(keys, n_shards, tolerance))).withColumn(
        "__slice", F.substring("__key", GROUP_DIGITS + 1, SLICE_DIGITS)
    )
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(
        "shard", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )  # at most 16 ** SLICE_DIGITS rows a shard
    inside = Window.partitionBy("shard", "__slice").orderBy("__key", "doc_id")
    return placed.join(starts, ["shard", "__slice"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
    files_per_shard: int = 16,
) -> None:
    """Write ``docs`` as parquet under ``path``/shard=K, all columns kept but one of the name shard, after one exchange (up to ``files_per_shard`` files a folder)."""
    keys = checkpointed(keyed(docs, id_col, text_col))
    splitters = find_splitters(keys, n_shards)
    t = text_or_empty(text_col)
    out = docs.withColumn("__key", key_of(t, F.col(id_col))).withColumn("shard", shard_of(splitters))
    part = F.conv(F.substring("__key", GROUP_DIGITS + 1, SLICE_DIGITS), 16, 10).cast("int") % files_per_shard
    out.repartition(n_shards * files_per_shard, "shard", part).drop("__key").write.partitionBy("shard").parquet(path)
