"""Importance resampling against a plain recomputation, and its sorting by regular sampling."""

import math
import re
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from storelens.llm import resample as R

from .helpers import frame, lowered, rows_of


def features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(ws), [crc32(f.encode()) % 10000 for f in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))]]


def brute(rows, target):
    s, t = [0] * 10000, [0] * 10000
    for into, texts in ((s, [r[1] for r in rows]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + 10000) / ((s[i] + 1) * (sum(t) + 10000)))) for i in range(10000)]
    out, able = [], []
    for i, text in rows:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score))
        if n >= 20:
            able.append((-score, i is None, i or 0, len(out) - 1))
    rank = {at: k for k, (*_, at) in enumerate(sorted(able)[: 25 * len(able) // 100], 1)}
    return [(*r, rank.get(at)) for at, r in enumerate(out)]


def test_equals_plain_recomputation(spark):
    words = "sun moon Star éclair größe a1 ñ the of and 42".split()
    rows = [(i, " ".join(words[(i * k * k + k) % (3 + i % 9)] for k in range(5 + i % 60))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "--- !! .."), (None, rows[40][1]), (403, "x" * 50_000 + " sun " * 30), (404, "Sun,MOON;sun\nmoon " * 8000)]
    target = ["the moon and the star of the sun 42 " * 5, None, "größe ñ"]
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(target)], "item_id string, text string")
    got = rows_of(R.resample(frame(spark, rows), bench))
    assert sorted(got, key=repr) == sorted(brute(rows, target), key=repr)


def test_parts_of_long_texts_join(monkeypatch):
    text = ("Words and more wörds; " * 40).encode()
    whole = [b for _, f in R.feature_buckets(text) for b in f.tolist()]
    monkeypatch.setattr(R, "PART_BYTES", 7)
    cut = [b for _, f in R.feature_buckets(text) for b in f.tolist()]
    assert sorted(cut) == sorted(whole) == sorted(features(text.decode())[1])
    assert sum(n for n, _ in R.feature_buckets(text)) == 160


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d " * 6)] * 8
    bench = spark.createDataFrame([], "text string")
    got = rows_of(R.resample(frame(spark, rows), bench))
    assert sorted(r[4] for r in got if r[4]) == [1, 2] and len(got) == 8
    assert rows_of(R.resample(frame(spark, rows).limit(0), bench)) == []


@pytest.mark.parametrize("segment_rows, least", [(1_000_000, 256), (10, 3), (1, 1)])
def test_ranks_with_heavy_ties(spark, monkeypatch, segment_rows, least):
    monkeypatch.setattr(R, "SEGMENT_ROWS", segment_rows)
    monkeypatch.setattr(R, "MIN_SEGMENTS", least)
    runs = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7).cast("long").alias("score"),
    ).repartition(5).sortWithinPartitions(F.desc("score"), "doc_id").checkpoint()
    got = {r.doc_id: r["rank"] for r in R.draw_ranks(runs, 700, 2000).collect()}
    order = sorted(range(2000), key=lambda i: (-(5 if i % 3 == 0 else i % 7), i))
    assert got == {i: k if k <= 700 else None for k, i in enumerate(order, 1)}
