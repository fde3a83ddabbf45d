"""Importance resampling towards a target distribution.

1. Features of a text are its words and pairs of neighbouring words (A-Z
   lower-cased; words are runs of ASCII digits, letters and other than ASCII).
   A feature's bucket is the crc32 of its bytes modulo BUCKETS. Every task adds
   up the buckets of all its texts in one array, so that at most BUCKETS rows a
   task are shuffled; the sums, BUCKETS rows, give one array of gains: the log
   ratio of a bucket's smoothed shares in the target and in the documents.
2. A document's weight is the mean gain of its features, its score the weight
   plus Gumbel noise drawn from a hash of its id, so that the highest scores
   are a sample without replacement, weighted by exp(weight).
3. Exact ranks come from parallel sorting by regular sampling. Every partition
   of scored rows is a sorted run; each gives its regular samples, from which
   splitters are taken. All runs are cut by them into segments, whose counts,
   one row each, have prefix sums. Segments before the last rank drawn are
   exchanged and merged, and a row's rank is its place in its segment after
   the segments before. Scores may be tied as often as they like: splitters
   are pairs of score and id.

The number of segments follows the number of rows (SEGMENT_ROWS); regular
samples on the driver are OVERSAMPLE a segment and at most one a run more.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from storelens.llm.common import text_or_empty
from storelens.session import cut_lineage

BUCKETS = 10_000
#: Documents with fewer words are never drawn; so many of 100 of the others are.
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Rows of a segment, about; the least number of segments; regular samples a segment.
SEGMENT_ROWS = 1_000_000
MIN_SEGMENTS = 256
OVERSAMPLE = 16
#: Texts are taken in parts of about this many bytes, cut between words.
PART_BYTES = 1 << 22

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, in parts."""
    at = 0
    while at < len(data):
        cut = BREAK.search(data, at + PART_BYTES) if at + PART_BYTES < len(data) else None
        end = cut.start() if cut else len(data)
        yield WORDS.findall(data, at, end)
        at = end


def feature_buckets(data: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Of every part of a text (UTF-8): the number of its words, and the buckets of its features, repeats included."""
    last = None
    for words in _word_lists(data.lower()):
        if not words:
            continue
        ones = [crc32(w) for w in words]
        heads = ones if last is None else [last, *ones]
        pairs = [crc32(w, crc32(b" ", h)) for h, w in zip(heads, words[1:] if last is None else words, strict=False)]
        last = ones[-1]
        yield len(words), np.array(ones + pairs, dtype=np.int64) % buckets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of all texts of a task."""
    total, held, size = np.zeros(BUCKETS, dtype=np.int64), [], 0
    for batch in batches:
        for text in batch.column("text"):
            for _, found in feature_buckets(text.as_py()):
                held.append(found)
                size += len(found)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
    some = np.flatnonzero(total)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])


def _utf8(c: Column) -> Column:
    return text_or_empty(c).cast("binary")


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in every bucket, over all rows."""
    per_task = texts.select(_utf8(texts[text_col]).alias("text")).mapInArrow(_count, "bucket bigint, n bigint")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of every bucket, target to raw."""
    all_raw, all_target = int(raw.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_raw + BUCKETS) / ((s + 1) * (all_target + BUCKETS))))
            for s, t in zip(raw.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def noise(doc_id: str, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_features, weight, score and eligible (at least MIN_WORDS words)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted, weights, scores, enough = [], [], [], []
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                n = n_words = total = 0
                for k, found in feature_buckets(text.as_py()):
                    n_words, n, total = n_words + k, n + len(found), total + int(shared.value[found].sum())
                counted.append(n)
                weights.append(total // n if n else 0)
                scores.append(weights[-1] + noise(name.as_py()))
                enough.append(n_words >= MIN_WORDS)
            longs = [pa.array(x, pa.int64()) for x in (counted, weights, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *longs, pa.array(enough, pa.bool_())],
                ["doc_id", "n_features", "weight", "score", "eligible"],
            )

    source = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("name"),
        _utf8(docs[text_col]).alias("text"),
    )
    return source.mapInArrow(
        run, f"doc_id {id_type}, n_features bigint, weight bigint, score bigint, eligible boolean"
    )


def _key(score: int, doc_id) -> tuple:
    """Place of a row in the order of ranks: higher scores first, then smaller ids, null last."""
    return (-score, doc_id is None, 0 if doc_id is None else doc_id)


def regular_samples(runs: DataFrame, step: int) -> list[tuple]:
    """Keys of every ``step``-th row of every sorted run, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(-(seen + 1) % step, batch.num_rows, step)
            seen += batch.num_rows
            yield batch.take(pa.array(at, pa.int64()))

    rows = runs.select("score", "doc_id")
    return sorted(_key(r["score"], r["doc_id"]) for r in rows.mapInArrow(run, rows.schema).collect())


def _in_segments(runs: DataFrame, splitters: list[tuple], starts: list[int] | None = None, last: int = 0) -> DataFrame:
    """Rows with their segment, or, given the rows before every segment, those that may be drawn with segment and start."""
    held = runs.sparkSession.sparkContext.broadcast((splitters, starts))  # one key and one number a segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters, starts = held.value
        for batch in batches:
            keys = zip(batch.column("score").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
            segment = [bisect_left(splitters, _key(*k)) for k in keys]
            start = [starts[s] if starts else 0 for s in segment]
            columns = [*batch.columns, pa.array(segment, pa.int32()), pa.array(start, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "segment", "start"])

    schema = runs.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",segment:int,start:bigint"
    return runs.mapInArrow(run, schema.replace(":", " "))


def draw_ranks(runs: DataFrame, drawn: int, rows: int) -> DataFrame:
    """``runs`` (doc_id, n_features, weight, score; sorted within partitions) with rank 1 to ``drawn``, null behind."""
    blank = F.lit(None).cast("bigint").alias("rank")
    if not drawn:
        return runs.select("*", blank)
    segments = max(MIN_SEGMENTS, math.ceil(rows / SEGMENT_ROWS))
    samples = regular_samples(runs, max(1, rows // (segments * OVERSAMPLE)))
    places = sorted({len(samples) * i // segments for i in range(1, segments)})
    splitters = [samples[i] for i in places if i < len(samples)]
    counted = _in_segments(runs.select("doc_id", "score"), splitters).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    counts = dict(counted.collect())  # one row a segment
    starts = [0, *itertools.accumulate(counts.get(i, 0) for i in range(len(splitters) + 1))][:-1]
    placed = _in_segments(runs, splitters, starts)
    order = Window.partitionBy("segment").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    merged = placed.filter(F.col("start") < drawn).withColumn("rank", F.col("start") + F.row_number().over(order))
    merged = merged.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    behind = placed.filter(F.col("start") >= drawn)
    return merged.select(*runs.columns, "rank").unionByName(behind.select(*runs.columns, blank))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank (null if not drawn).

    Drawn are, of the N rows with at least MIN_WORDS words, the
    floor(``percent`` * N / 100) with the highest scores; ties go to the smaller
    id, a null id (hashed as the empty text) last; of rows repeated with one id
    the order among themselves is by features and weight. A null or empty text
    has no features, weight 0, and is never drawn. Texts of any length are taken
    whole, in parts. An empty table gives no rows, an empty target gains of the
    documents' shares alone. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    scored = score(docs, gain, id_col, text_col)
    runs = cut_lineage(scored.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id")))
    rows = runs.filter("eligible").count()
    ranked = draw_ranks(runs.filter("eligible").drop("eligible"), rows * percent // 100, rows)
    rest = runs.filter("not eligible").drop("eligible").withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest)
