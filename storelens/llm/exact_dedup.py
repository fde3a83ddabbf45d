"""Exact dedup by deterministic block naming (DataFrame functions only).

Each normalised text is cut into blocks of ``block_bytes`` bytes. All distinct
blocks of the corpus are sorted and numbered, so a block gets an integer name
that no different block has. Adjacent names are then paired, the distinct pairs
sorted and numbered in turn, and so on until each document has one name. Two
documents are equal exactly when they have the same number of blocks and the
same last name; no comparison rests on a hash alone.

Scale: the text itself is shuffled once, as distinct blocks with map-side
combining (a text held by a third of all rows is sent once per task). Rows
find the names of their blocks through a 64-bit block hash; the naming pass
counts the distinct blocks behind every hash, and hashes with several blocks
are resolved by joining on the block bytes. Joins are left to AQE, which
splits a hot name. Every level halves the rows, and is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.llm.common import ascii_lower, by_content, checkpointed, text_or_empty, written
from storelens.session import shared_scope

BLOCK_BYTES = 1 << 15


def block_hash(block: str) -> str:
    """SQL of the 64-bit hash that leads from a block to its name (tests put in a colliding one)."""
    return f"xxhash64({block})"


def normalised(text_col: str) -> Column:
    """Null as empty, A-Z lower-cased."""
    return ascii_lower(text_or_empty(text_col))


def _blocked(docs: DataFrame, text_col: str, block_bytes: int) -> DataFrame:
    """One row per document: __t (normalised text), __b (its bytes), __n (number of blocks, 1 for the empty text)."""
    return docs.select(normalised(text_col).alias("__t")).select(
        F.col("__t").cast("binary").alias("__b"),
        F.expr(f"cast(greatest(1, ceil(octet_length(__t) / {block_bytes})) as int)").alias("__n"),
    )


def _block_array(block_bytes: int) -> str:
    return f"transform(sequence(0, __n - 1), i -> substring(__b, i * {block_bytes} + 1, {block_bytes}))"


def _number(distinct: DataFrame, by: list[str], drop: str = "") -> DataFrame:
    """Integer names for distinct rows: sorted in their hash partitions and numbered (partition above, rank below)."""
    named = distinct.sortWithinPartitions(*by).withColumn("__name", F.monotonically_increasing_id())
    return written(named.drop(drop), per_core=8)


def number_blocks(docs: DataFrame, text_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(__h, __name) of all distinct blocks, and the hashes (__h) that more than one block has."""
    blocks = (
        _blocked(docs, text_col, block_bytes)
        .select(F.explode(F.expr(_block_array(block_bytes))).alias("__block"))
        .select(F.expr(block_hash("__block")).alias("__h"), "__block")
    )
    names = _number(blocks.select("__h", "__block").distinct(), ["__h", "__block"], drop="__block")
    return names, names.groupBy("__h").count().filter("count > 1").select("__h")


def name_blocks(rows: DataFrame, names: DataFrame, shared: DataFrame, block_bytes: int) -> DataFrame:
    """Names of all blocks of the rows: (__rid, __n, __pos, __name). If hashes are shared the rows hold the bytes (__b)."""
    exploded = rows.select("__rid", "__n", F.posexplode("__hs").alias("__pos", "__h"))
    columns = ["__rid", "__n", "__pos", "__name"]
    if "__b" not in rows.columns:
        return exploded.join(names, "__h").select(*columns)
    # blocks behind a shared hash are named by their bytes; negative, so that no other name is met
    held = rows.select("__rid", "__n", F.posexplode(F.expr(_block_array(block_bytes))).alias("__pos", "__block"))
    held = held.withColumn("__h", F.expr(block_hash("__block"))).join(shared, "__h", "left_semi")
    exact = _number(held.select("__block").distinct(), ["__block"]).withColumn("__name", -1 - F.col("__name"))
    sole = exploded.join(shared, "__h", "left_anti").join(names, "__h")
    return sole.select(*columns).unionByName(held.join(exact, "__block").select(*columns))


def exact_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and all empty texts are equal. Of equal texts the row with the
    largest id is kept (a null id is below every other). Rows repeated with the
    same id and text are rows of the group, and exactly one of them is kept.
    An empty table gives an empty result. Other columns of ``docs``, whatever
    their names, are not read.
    """
    with shared_scope(docs.sparkSession):  # all written tables go once the classes are checkpointed
        return _classes(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), block_bytes)


def _classes(docs: DataFrame, block_bytes: int) -> DataFrame:
    names, shared = number_blocks(docs, "__text", block_bytes)
    rows = docs.select("__id", normalised("__text").alias("__t")).select(
        F.monotonically_increasing_id().alias("__rid"),
        "__id",
        F.unhex(F.sha2("__t", 256)).alias("__sha"),
        F.col("__t").cast("binary").alias("__b"),
        F.expr(f"cast(greatest(1, ceil(octet_length(__t) / {block_bytes})) as int)").alias("__n"),
    )
    hashes = F.expr(f"transform({_block_array(block_bytes)}, b -> {block_hash('b')})").alias("__hs")
    held = [] if shared.isEmpty() else ["__b"]
    rows = written(rows.select("__rid", "__id", "__sha", "__n", hashes, *held), per_core=8)
    level = name_blocks(rows, names, shared, block_bytes)
    widest = rows.agg(F.max("__n")).first()[0] or 1
    level = written(level) if widest > 1 else level
    done = [level.filter("__n = 1").select("__rid", "__n", "__name")]
    width = 1
    while width < widest:  # one step per doubling of the longest text
        width *= 2
        pairs = written(
            level.filter(f"__n > {width // 2}")
            .groupBy("__rid", "__n", F.expr("__pos div 2").alias("__pos"))
            .agg(
                F.max(F.expr("if(__pos % 2 = 0, __name, null)")).alias("__l"),
                F.expr("coalesce(max(if(__pos % 2 = 1, __name, null)), -9223372036854775808)").alias("__r"),
            )
        )
        names = _number(pairs.select("__l", "__r").distinct(), ["__l", "__r"])
        level = written(pairs.join(names, ["__l", "__r"]).select("__rid", "__n", "__pos", "__name"))
        done.append(level.filter(f"__n <= {width}").select("__rid", "__n", "__name"))
    named = done[0]
    for d in done[1:]:
        named = named.unionByName(d)
    named = checkpointed(named.join(rows.select("__rid", "__id", "__sha"), "__rid"))
    # checkpointed, so that the join below is between two exchanges and a large group's rows can be split
    groups = checkpointed(
        named.groupBy("__n", "__name").agg(
            F.max(F.struct("__id", "__rid")).alias("__keep"), F.count(F.lit(1)).alias("group_size")
        )
    )
    return named.join(groups, ["__n", "__name"]).select(
        F.col("__id").alias("doc_id"),
        F.col("__keep.__id").alias("keep_id"),
        "group_size",
        (F.col("__rid") == F.col("__keep.__rid")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they were.

    Rows are found again by id and digest of the text; of rows with the same
    id and text the one with the least hash of all columns stays.
    """
    kept = exact_classes(docs, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")
    )
    mine = docs.withColumn("__own_sha", F.sha2(normalised(text_col), 256))
    once = Window.partitionBy(F.col(id_col), F.col("__own_sha")).orderBy(by_content(docs))
    return (
        mine.join(kept, mine[id_col].eqNullSafe(kept["__id"]) & (mine["__own_sha"] == kept["__sha"]), "left_semi")
        .withColumn("__nth", F.row_number().over(once))
        .filter("__nth = 1")
        .drop("__own_sha", "__nth")
    )
