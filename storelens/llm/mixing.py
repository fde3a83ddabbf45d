"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target in words. Whole passes over the source are taken as
often as they fit (no document more than twice); what is left of the budget is
filled from the source's histogram of exact document lengths: a proportional
share of every length first, then longest first, then a bounded-knapsack
dynamic program over the lengths still in hand, which meets the remaining
budget exactly or as nearly as any subset of them can. The plan says how many
documents of every length are taken; which ones is decided by a seeded hash.

Scale: histograms are grouped counts; the dynamic program runs per source in
tasks, on one row per distinct length. Documents are ranked inside (source,
length, hash bucket), so a length shared by a third of all rows is divided
over 256 tasks. Source targets need a few scalars a round, never the sources
themselves, on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.llm.common import WORD, checkpointed, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
SEED = 8
BUCKETS = 256
#: Words left to the dynamic program where the lengths allow it.
DP_WORDS = 1 << 20
#: Sources ranked together in one range task at most about this many.
RANK_ROWS = 100_000

PLAN = "__k string, size long, __full int, __pick long"


def n_words(text_col: str) -> Column:
    return F.size(F.regexp_extract_all(text_or_empty(text_col), F.lit(WORD), F.lit(0))).cast("long")


def source_key(source_col: str) -> Column:
    """A text that is never null and sorts as the sources do: by code point, null last."""
    s = F.col(source_col).cast("string")
    return F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s))


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Distinct sources (__k) with __rank from 0 in key order, numbered in ranges (no task sees all of them)."""
    total = sources.count()
    ranged = checkpointed(
        sources.repartitionByRange(max(1, -(-total // RANK_ROWS)), "__k")
        .sortWithinPartitions("__k")
        .withColumn("__range", F.spark_partition_id())
    )
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy("__k")
    return ranged.join(starts, "__range").withColumn("__rank", F.col("__start") + F.row_number().over(inside) - 1)


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Per source (__k, __size): target, its weighted share of ``share`` x all sizes, at most ``most`` x its size.

    What a full source cannot take is shared again by weight until no target
    is above its bound: the level (words per unit of weight) of the sources
    below their bound rises from round to round.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(ranked_sources(sources).select("__k", "__size", w.alias("__w")))
    level, full = 0.0, -1
    bound = F.col("__size") * float(most)
    budget = float(ranked.agg(F.sum("__size")).first()[0] or 0) * share
    while True:
        over = bound < F.col("__w") * F.lit(level)
        r = ranked.agg(
            F.sum(over.cast("int")).alias("n"), F.sum(F.when(over, bound)).alias("b"), F.sum(F.when(~over, F.col("__w"))).alias("w")
        ).first()
        if (r["n"] or 0) == full or not r["w"]:
            break
        full = r["n"] or 0
        level = (budget - (r["b"] or 0.0)) / r["w"]
    return ranked.select("__k", "__size", F.least(bound, F.col("__w") * F.lit(level)).alias("target"))


def knapsack(lengths: np.ndarray, have: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take (at most ``have``), for a sum as near below ``budget`` as possible.

    via[s] is the item that first reached the sum s; each item (length times a
    power of two, so that a bounded count takes few items) is used once, so
    walking back from the best sum gives the counts.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return take
    via = np.full(budget + 1, -1, dtype=np.int32)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, part = int(lengths[i]), int(min(have[i], budget // max(1, lengths[i]))), 1
        if length <= 0:
            continue
        while left > 0 and not reached[budget]:
            n = min(part, left)
            step = length * n
            if step <= budget:
                new = reached[: budget + 1 - step] & ~reached[step:]
                spots = np.flatnonzero(new) + step
                via[spots] = len(items)
                reached[spots] = True
                items.append((int(i), n))
            left -= n
            part *= 2
        if reached[budget]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s > 0:
        i, n = items[via[s]]
        take[i] += n
        s -= int(lengths[i]) * n
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents to take of each length, once each, for a sum as near below ``budget`` as the lengths allow."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([c * budget // total for c in counts.tolist()], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    reserve = min(int(lengths.max(initial=0)), DP_WORDS)  # what the dynamic program is left with
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] > 0 and left > reserve:
            n = min(int(counts[i] - take[i]), (left - reserve) // int(lengths[i]))
            take[i] += n
            left -= n * int(lengths[i])
    return take + knapsack(lengths, counts - take, int(left))


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Plan of one source from its histogram rows (size, __n, target)."""
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["__n"].to_numpy(np.int64)
    total, budget = int((lengths * counts).sum()), int(pdf["target"].iloc[0])
    full = min(MOST_COPIES, budget // total) if total else 0
    pick = fit_budget(lengths, counts, budget - full * total) if full < MOST_COPIES else np.zeros_like(counts)
    return pd.DataFrame({"__k": pdf["__k"], "size": lengths, "__full": full, "__pick": pick})


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies (0, 1 or 2), and the columns ``keep``.

    Size is the number of words (null text: 0). Null is a source of its own,
    the last one. Empty documents weigh nothing and are taken in proportion.
    Ties of the seeded hash (rows with the same id) go by id and text hash;
    rows that agree in both are interchangeable. A source without words has
    target 0. An empty table gives no rows.
    """
    sized = docs.select(
        F.col(id_col).alias("__id"),
        source_key(source_col).alias("__k"),
        n_words(text_col).alias("size"),
        F.xxhash64(F.lit(SEED), F.col(id_col)).alias("__h"),
        F.xxhash64(text_or_empty(text_col)).alias("__x"),
        *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)],
    ).withColumn("__bucket", F.pmod(F.col("__h"), F.lit(BUCKETS)).cast("int"))
    if not keep:
        sized = checkpointed(sized)
    cells = checkpointed(sized.groupBy("__k", "size", "__bucket").agg(F.count(F.lit(1)).alias("__n")))
    lengths = cells.groupBy("__k", "size").agg(F.sum("__n").alias("__n"))
    targets = checkpointed(source_targets(lengths.groupBy("__k").agg(F.sum(F.col("size") * F.col("__n")).alias("__size"))))
    plan = (
        lengths.join(targets, "__k").select("__k", "size", "__n", "target").groupBy("__k").applyInPandas(_plan, PLAN)
    )
    before = Window.partitionBy("__k", "size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
        .join(plan, ["__k", "size"])
        .join(targets, "__k")
    )
    key = ["__k", "size", "__bucket"]
    inside = Window.partitionBy(*key).orderBy("__h", "__id", "__x")
    return (
        sized.join(cells, key)
        .withColumn("__nth", F.col("__start") + F.row_number().over(inside))
        .select(
            F.col("__id").alias("doc_id"), "size", F.col("__size").alias("source_size"), "target",
            (F.col("__full") + (F.col("__nth") <= F.col("__pick")).cast("int")).alias("copies"),
            *[F.col(f"__keep_{i}").alias(f"__kept_{c}") for i, c in enumerate(keep)],
        )
    )


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return mix_copies(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of ``docs`` that the mix takes, those taken twice as two rows; columns as they were."""
    mixed = mix_copies(docs, keep=docs.columns).filter("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.expr("sequence(1, copies)"))).select(
        *[F.col(f"__kept_{c}").alias(c) for c in docs.columns]
    )
