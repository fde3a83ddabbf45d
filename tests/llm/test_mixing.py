import itertools
import random

import numpy as np

from storelens.llm import mixing as M

from .helpers import frame, words


def brute_targets(sizes: dict, share=1.5):
    """Shares resharing round by round, sources in code point order, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        per = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if per * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else per * weight[s] for s in order}
        full |= over


def test_mix_meets_the_targets(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.randint(0, 400)), rng.choice(["a", "b", "ä", "Z", "10", "9", None, ""])) for i in range(1500)]
    docs += [(5000 + i, "w " * 50, "hot") for i in range(800)] + [(9000, None, "tiny"), (9001, "one", "tiny"), (9002, "", "void")]
    got = M.mix_sources(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want, source = brute_targets(sizes), {i: s for i, _, s in docs}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s]
        assert r["size"] == 0 and r.taken == 0 or r.taken % r["size"] == 0 and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s, t in want.items():
        assert int(t) - 1 <= taken[s] <= t + 1e-6, (s, taken[s], t)  # lengths from 1 on: the budget is met
    again = {(r.doc_id, r.taken) for r in M.mix_sources(frame(spark, docs, 5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_repeated_rows_and_empty_table(spark):
    assert M.mix_sources(frame(spark, [])).collect() == []
    got = M.mix_sources(frame(spark, [(1, "a b c", "s")] * 50)).collect()
    assert sum(r.taken for r in got) == 225  # 1.5 x 150 words, in steps of 3
    assert M.mix_sources(frame(spark, [(1, None, None)])).collect()[0].taken == 0


def test_applied_mix_repeats_rows(spark):
    docs = frame(spark, [(i, "w " * (i % 9 + 1), "s") for i in range(200)])
    out = M.apply_mix(docs)
    assert out.columns == docs.columns
    n = sum(len(words(r.text)) for r in out.collect())
    assert n == int(1.5 * sum(i % 9 + 1 for i in range(200)))


def test_knapsack_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.array(sorted(rng.choice(np.arange(2, 30), 4, replace=False)))
        have, budget = rng.integers(0, 4, 4), int(rng.integers(0, 120))
        best = max(
            s for c in itertools.product(*[range(h + 1) for h in have]) if (s := int((lengths * np.array(c)).sum())) <= budget
        )
        take = M.knapsack(lengths, have, budget)
        assert (take <= have).all() and int((lengths * take).sum()) == best
        take = M.fit_budget(lengths, have, budget)
        assert (take <= have).all() and int((lengths * take).sum()) <= budget or budget >= int((lengths * have).sum())


def test_many_lengths_meet_the_budget_exactly():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 20000, 3000))
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.01, 0.37, 0.5, 0.99):
        take = M.fit_budget(lengths, counts, int(total * share))
        assert (take <= counts).all() and int((lengths * take).sum()) == int(total * share)
