import hashlib

import pytest

from storelens.llm import exact_dedup as D

from .helpers import frame, lowered, rows_of

LONG = "Block " * 9000  # several blocks
DOCS = [
    (1, "A b"), (2, "a B"), (3, "a b "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, LONG), (9, LONG.upper()),
    (10, LONG + "x"), (11, "x" + LONG), (12, "same"), (12, "same"), (None, "null id"), (None, "Null id"), (13, "null ID"),
]


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(lowered(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(spark, docs):
    got = rows_of(D.exact_classes(frame(spark, docs)))
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == brute(docs)
    kept = {}
    for r in got:
        kept.setdefault(r[4], []).append(r)
    for rows in kept.values():  # exactly one row of a group stays, and it has the kept id
        assert [r[0] for r in rows if r[3]] == [rows[0][1]]


def test_equals_brute_force(spark):
    check(spark, DOCS)


@pytest.mark.parametrize("buckets", [1, 3])
def test_colliding_block_hashes_do_not_merge_texts(spark, monkeypatch, buckets):
    monkeypatch.setattr(D, "block_hash", lambda block: f"cast(octet_length({block}) % {buckets} as bigint)")
    check(spark, DOCS)


def test_small_blocks_many_levels(spark, monkeypatch):
    docs = [(i, "ab" * (i % 7 + 1) + "c" * (i % 3)) for i in range(60)]
    got = rows_of(D.exact_classes(frame(spark, docs), block_bytes=2))
    assert sorted(((r[0], r[1], r[2], r[4]) for r in got), key=repr) == brute(docs)


def test_empty_table(spark):
    assert rows_of(D.exact_classes(frame(spark, []))) == []
    assert rows_of(D.drop_exact_copies(frame(spark, []))) == []


def test_drop_keeps_rows_and_columns(spark):
    docs = frame(spark, DOCS)
    kept = D.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [lowered(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({lowered(t) for _, t in DOCS})


def test_main_path_is_native(spark):
    plan = D.exact_classes(frame(spark, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
