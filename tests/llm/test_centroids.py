"""Centroid clustering against a plain recomputation."""

import math
import random
from hashlib import sha256

import pytest

from storelens.llm import centroids as C

from .helpers import rows_of

SCHEMA = "vec_id long, embedding array<double>, cluster string, v string, ids string, label string"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", "x", "x", None) for r in rows], SCHEMA).repartition(partitions)


def brute(rows, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**21 for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    name = lambda i: sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = [[] for _ in cs]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cs = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, cs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == j) for j in range(len(cs))]
    return [(i, c, d, inertia[c], sum(inertia), sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found]


def vectors(n, seed=3, spread=0.3):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss((i % 5) * 0.2 - 0.4, spread) for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("page", [1 << 14, 7])
def test_equals_plain_recomputation(spark, monkeypatch, page):
    monkeypatch.setattr(C, "PAGE_ROWS", page)
    rows = vectors(150)
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [None] + [0.1] * 63), (904, [float("nan")] * 64)]
    rows += [(905, [float("-inf")] + [0.0] * 63), (906, [1e300] * 64), (None, [0.25] * 64), (907, [-2097151.0] * 64)]
    rows += [rows[3]] * 4 + [(908, rows[4][1]), (908, rows[9][1])]
    got = rows_of(C.cluster_vectors(table(spark, rows)))
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_ties_and_few_vectors(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(9)]  # equal centroids: the smaller number wins, the others stay
    assert sorted(rows_of(C.cluster_vectors(table(spark, rows)))) == sorted(brute(rows))
    one = [(5, [-0.001] * 64)]
    assert rows_of(C.cluster_vectors(table(spark, one))) == brute(one)
    assert brute(one)[0][2] == 0


def test_empty_tables(spark):
    assert rows_of(C.cluster_vectors(table(spark, []))) == []
    assert rows_of(C.cluster_vectors(table(spark, [(1, None), (2, [1.0])]))) == []


def test_pages_lose_nothing(spark):
    rows = vectors(40)
    kept = C.kept_vectors(table(spark, rows, 1))
    page = kept.mapInArrow(C.encode, "ids array<bigint>, sizes array<int>, words array<bigint>, codes binary").collect()[0]
    import numpy as np

    blocks = C.dictionaries({"ids": page.ids, "sizes": np.array(page.sizes), "words": np.array(page.words), "codes": bytes(page.codes)})
    back = np.concatenate([words[codes] for words, codes in blocks], axis=1)
    want = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    assert {i: v for i, v in zip(page.ids, back.tolist(), strict=True)} == want
