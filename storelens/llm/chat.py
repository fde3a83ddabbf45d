"""Chat formatting with collapse of cumulative snapshots (DataFrame functions only).

Logged conversations are often snapshots: the same turns once more with a few
added. Every turn gets its place in its conversation and every prefix of a
conversation a rolling 128-bit hash: the exclusive-or of the hashes of (place,
role, text) of its turns. Of equal conversations the one with the least id
stays, and it is dropped when its last prefix hash is that of a proper prefix
elsewhere (an anti-join). The rest is rendered.

Scale: running counts and hashes are taken in blocks of TURN_BLOCK turns and
joined by the blocks' own totals, so one endless conversation is spread over
many tasks; it is rendered in parts of PART_TURNS turns. Texts are shuffled
once, to be rendered; everything before works on their hashes. Shared first
turns are combined map-side before the anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from storelens.llm.common import checkpointed


TURN_BLOCK = 256
PART_TURNS = 256
NAMES = ("conv_id", "turn", "role", "text")


def _turns(conversations: DataFrame, names=NAMES) -> DataFrame:
    """__k (a key that is never null), __id, __turn, __role, __text, and two hashes of role and text."""
    conv, turn, role, text = (F.col(c) for c in names)
    bare = conversations.select(
        conv.alias("__id"),
        turn.cast("long").alias("__turn"),
        F.coalesce(role.cast("string"), F.lit("")).alias("__role"),
        F.coalesce(text.cast("string"), F.lit("")).alias("__text"),
    )
    return bare.select(
        F.when(F.col("__id").isNull(), F.lit("null")).otherwise(F.concat(F.lit("id "), F.col("__id").cast("string"))).alias("__k"),
        "*",
        F.xxhash64("__role", "__text").alias("__c1"),
        F.xxhash64(F.lit(9), "__text", "__role").alias("__c2"),
    )


def prefix_hashes(conversations: DataFrame, names=NAMES) -> DataFrame:
    """Per distinct turn: __k, __id, __turn, __c1, __c2, __pos (from 1), and __p1, __p2, the hash of the prefix that ends there."""
    turns = checkpointed(
        _turns(conversations, names)
        .select("__k", "__id", "__turn", "__c1", "__c2")
        .distinct()
        .withColumn("__block", F.coalesce(F.expr(f"__turn div {TURN_BLOCK}"), F.lit(-(2**62))))
    )
    key = ["__k", "__block"]
    before = Window.partitionBy("__k").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*key).orderBy(F.col("__turn").asc_nulls_first(), "__c1", "__c2")
    upto = Window.partitionBy(*key).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    counts = turns.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*key, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = checkpointed(
        turns.join(starts, key)
        .withColumn("__pos", F.col("__start") + F.row_number().over(inside))
        .drop("__start")
        .withColumn("__z1", F.xxhash64("__pos", "__c1", "__c2"))
        .withColumn("__z2", F.xxhash64("__c2", "__pos", "__c1"))
    )
    sums = placed.groupBy(*key).agg(F.bit_xor("__z1").alias("__b1"), F.bit_xor("__z2").alias("__b2"))
    zero = F.lit(0).cast("long")
    heads = sums.select(
        *key,
        F.coalesce(F.bit_xor("__b1").over(before), zero).alias("__h1"),
        F.coalesce(F.bit_xor("__b2").over(before), zero).alias("__h2"),
    )
    return placed.join(heads, key).select(
        "__k", "__id", "__turn", "__c1", "__c2", "__pos",
        F.bit_xor("__z1").over(upto).bitwiseXOR(F.col("__h1")).alias("__p1"),
        F.bit_xor("__z2").over(upto).bitwiseXOR(F.col("__h2")).alias("__p2"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """__k, __id, __n of the conversations that are no prefix of another (of equal ones: the least id, null first)."""
    ends = prefixes.groupBy("__k", "__id").agg(
        F.max("__pos").alias("__n"), F.max_by(F.struct("__p1", "__p2"), "__pos").alias("__p")
    )
    ends = checkpointed(ends.select("__k", "__id", "__n", "__p.__p1", "__p.__p2"))
    longer = (
        prefixes.join(ends.select("__k", "__n"), "__k")
        .filter("__pos < __n")
        .select(F.col("__pos").alias("__n"), "__p1", "__p2")
        .distinct()
    )
    # equal conversations become one before the anti-join: a conversation that many logs share is no hot key there
    first = ends.groupBy("__n", "__p1", "__p2").agg(F.min(F.struct("__id", "__k")).alias("__first"))
    return first.join(longer, ["__n", "__p1", "__p2"], "left_anti").select("__first.__k", "__first.__id", "__n")


def render(conversations: DataFrame, names=NAMES) -> DataFrame:
    """The maximal conversations as chat text: conv_id, part, n_turns (of the whole), n_chars, text.

    Each turn reads ``<|role|>``, line break, text, ``<|end|>``, line break; a
    ``<|`` within a text becomes ``< |`` so that no text can open a turn.
    Conversations of more than PART_TURNS turns come in parts numbered from 0.
    Turns are ordered by number, null first; different rows with one number go
    by their hashes. Rows repeated in a conversation count once; null role and
    text are empty; a null id is a conversation of its own. An empty table
    gives no rows. Other columns are not read.
    """
    prefixes = checkpointed(prefix_hashes(conversations, names))
    kept = prefixes.join(maximal(prefixes).select("__k", "__n"), "__k").select(
        "__k", "__n", "__pos", F.coalesce("__turn", F.lit(-(2**62))).alias("__t"), "__c1", "__c2"
    )
    turns = _turns(conversations, names).withColumn("__t", F.coalesce("__turn", F.lit(-(2**62))))
    line = F.concat(F.lit("<|"), "__role", F.lit("|>\n"), F.replace("__text", F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("__pos", line.alias("l")))), lambda x: x["l"]), "")
    return (
        turns.join(kept, ["__k", "__t", "__c1", "__c2"])
        .groupBy("__k", "__id", "__n", F.expr(f"(__pos - 1) div {PART_TURNS}").alias("part"))
        .agg(text.alias("text"))
        .select(
            F.col("__id").alias("conv_id"), "part", F.col("__n").alias("n_turns"),
            F.length("text").cast("long").alias("n_chars"), "text",
        )
    )
