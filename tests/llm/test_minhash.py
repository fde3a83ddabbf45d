import random
from collections import Counter

import numpy as np

from storelens.llm import minhash as M, shingles as S

from .helpers import frame, lowered, words


def brute_shingles(text):
    w = [lowered(x) for x in words(text)]
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_similarity(a, b):
    """The larger of plain and probability Jaccard, from the definitions."""
    if not a or not b:
        return float(not a and not b)
    both, union = a.keys() & b.keys(), a.keys() | b.keys()
    x = {d: 1 + np.log(a[d]) if a[d] else 0.0 for d in union}
    y = {d: 1 + np.log(b[d]) if b[d] else 0.0 for d in union}
    p = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in union) for d in both)
    return max(len(both) / len(union), p)


def brute_classes(docs):
    sets = [brute_shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if brute_similarity(sets[i], sets[j]) >= 0.8:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(docs, label, strict=True):
        least[x] = min(least.get(x, i), i)
    return {i: least[x] for (i, _), x in zip(docs, label, strict=True)}


def corpus(rng, n):
    def prose(k):
        return [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(k)]

    docs, passage = [], prose(40)
    for _ in range(n):
        base = prose(rng.randint(3, 120))
        if rng.random() < 0.3:
            base = passage + base  # a passage that many documents share
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(max(1, len(w) // rng.choice([15, 30, 60]))):
                w[rng.randrange(len(w))] = "edit"
            docs.append(" ".join(w))
    return list(enumerate(docs))


def test_shingles_equal_brute_force():
    rng = random.Random(0)
    for t in ["", "  \n", "one", "one two three four", "a b c d e a b c d e a b c d e", "É é É é É x\x0by\x0cz", "A b C d E f"]:
        hashes, counts = S.shingles(t)
        assert sorted(counts.tolist()) == sorted(brute_shingles(t).values())
    for _, t in corpus(rng, 20):
        assert sorted(S.shingles(t)[1].tolist()) == sorted(brute_shingles(t).values())


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = S.word_hashes(text)
    monkeypatch.setattr(S, "PART_BYTES", 100)
    assert (S.word_hashes(text) == whole).all()


def test_similarity_equals_the_definition():
    rng = random.Random(1)
    docs = [t for _, t in corpus(rng, 25)] + ["x y z " * 20, "x y z " * 30 + "q"]
    packed = [S.pack(*S.shingles(t)) for t in docs]
    for _ in range(300):
        i, j = rng.randrange(len(docs)), rng.randrange(len(docs))
        want = brute_similarity(brute_shingles(docs[i]), brute_shingles(docs[j]))
        assert abs(S.similarity(packed[i], packed[j]) - want) < 1e-9


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(2)
    error = []
    for _, t in corpus(rng, 40):
        w = t.split()
        edited = " ".join(x if rng.random() > 0.05 else "zz" for x in w)
        pair = [S.shingles(t), S.shingles(edited)]
        a, b = S.signatures(pair, 512)
        error.append((a == b).mean() - S.similarity(S.pack(*pair[0]), S.pack(*pair[1])))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05


def test_signatures_do_not_depend_on_the_batch():
    rng = random.Random(3)
    sets = [S.shingles(t) for _, t in corpus(rng, 20)]
    together = S.signatures(sets, 64)
    assert all((S.signatures([s], 64)[0] == together[i]).all() for i, s in enumerate(sets))


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.label for r in M.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        label[b] = a
    assert got == {x: find(x) for x in label if x in got} and set(got) >= {x for e in edges if e[0] != e[1] for x in e}


def test_classes_equal_brute_force(spark):
    docs = corpus(random.Random(5), 70)
    docs += [(900, None), (901, ""), (902, " \n"), (903, docs[0][1]), (904, docs[0][1].upper()), (905, "two words"), (906, "Two  Words")]
    got = M.near_classes(frame(spark, docs)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(docs)
    for r in got:
        assert r.kept == (r.doc_id == r.class_id)


def test_a_chain_in_one_bucket_is_followed(spark):
    """Each text is like the next one only, so the centre of a bucket does not see all links."""
    w = [f"w{i}" for i in range(200)]
    docs = []
    for step in range(9):
        docs.append((step, " ".join(w)))
        for k in range(4):
            w[step * 20 + k * 5] = f"new{step}_{k}"
    want = brute_classes(docs)
    assert len(set(want.values())) == 1
    assert {r.doc_id: r.class_id for r in M.near_classes(frame(spark, docs)).collect()} == want


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 2)
    docs = corpus(random.Random(6), 50)
    members = spark.createDataFrame([(1, i) for i, _ in docs], "b long, nid long")  # one bucket holds everything
    sets = spark.createDataFrame([(i, bytearray(S.pack(*S.shingles(t)))) for i, t in docs], "nid long, packed binary")
    got = {r.node: r.label for r in M.link_nodes(members, sets).collect()}
    want, classes = brute_classes(docs), {}
    for i, c in got.items():
        classes.setdefault(c, set()).add(i)
    brute = {}
    for i, c in want.items():
        brute.setdefault(c, set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, brute.values()))


def grouped(labels):
    out = {}
    for i, c in labels.items():
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def edited_apart(rng, copies, words_each=120):
    """Copies of one text: some edited a little, some so much that they are like no other; a few have repeated passages."""
    base = [f"w{i}" for i in range(words_each)]
    docs = []
    for i in range(copies):
        w = list(base)
        for k in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"own{i}_{k}"
        if i % 9 == 0:
            w = w[rng.randrange(12) :]
        if i % 11 == 0:
            w += w[:20] * rng.randrange(1, 4)
        docs.append((i, " ".join(w)))
    return docs


def test_edited_copies_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 2)
    docs = edited_apart(random.Random(12), 60, 70)
    members = spark.createDataFrame([(1, i) for i, _ in docs], "b long, nid long")
    sets = spark.createDataFrame([(i, bytearray(S.pack(*S.shingles(t)))) for i, t in docs], "nid long, packed binary")
    got = {r.node: r.label for r in M.link_nodes(members, sets).collect()}
    want = brute_classes(docs)
    assert 5 < len(set(want.values())) < 55
    assert grouped(got) == grouped(want)


def test_edited_copies_are_not_compared_in_pairs(spark, monkeypatch):
    """The pairs that are made grow with the copies, not with their square."""
    made = []
    verify, beside = M.verify, M.beside
    monkeypatch.setattr(M, "verify", lambda pairs, sets: made.append(pairs.count()) or verify(pairs, sets))
    monkeypatch.setattr(M, "beside", lambda groups, *more: made.append(groups.count()) or beside(groups, *more))
    rng, base = random.Random(3), [f"w{i}" for i in range(150)]
    docs = []
    for i in range(800):
        w = list(base)
        for k in range(rng.choice([2, 7, 9])):
            w[rng.randrange(150)] = f"own{i}_{k}"
        docs.append((i, " ".join(w)))
    M.near_classes(frame(spark, docs)).count()
    assert sum(made) < 20 * len(docs)


def test_recall_of_the_bands():
    """Of edited copies at 0.8 to 0.85, by either similarity, at least 0.99 share a band."""
    rng, met, total = random.Random(7), 0, 0
    while total < 400:
        w = [f"t{total}_{i}" for i in range(150)]
        if total % 2:
            w += w[:30] * 2
        v = list(w)
        for _ in range(rng.randint(2, 5)):
            v[rng.randrange(len(v))] = "edit"
        pair = [S.shingles(" ".join(x)) for x in (w, v)]
        if 0.8 <= S.similarity(*(S.pack(*s) for s in pair)) < 0.85:
            total += 1
            a, b = M.band_keys(pair)
            met += bool(set(a.tolist()) & set(b.tolist()))
    assert met >= 0.99 * total


def test_edge_cases(spark):
    assert M.near_classes(frame(spark, [])).collect() == []
    got = M.near_classes(frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert {r.class_id for r in got} == {3} and sum(r.kept for r in got) == 1
    docs = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "other words of a text")])
    kept = M.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def unequal(k):
    """100 words and a passage of 20 words, once and 40 times: alike by plain Jaccard only."""
    head, passage = " ".join(f"h{k}_{i}" for i in range(100)), " ".join(f"p{k}_{i}" for i in range(20))
    return f"{head} {passage}", head + f" {passage}" * 40


def test_passages_repeated_unequally_share_bands():
    for k in range(150):
        pair = [S.shingles(t) for t in unequal(k)]
        plain, prob = S.similarities(*(S.pack(*s) for s in pair))
        assert plain > 0.9 and prob < 0.8
        a, b = M.band_keys(pair)
        assert set(a.tolist()) & set(b.tolist())
        assert len(a) == M.REGISTERS // M.BAND_ROWS and len(b) > len(a)


def test_passages_repeated_unequally_are_linked(spark):
    docs = [(2 * k + i, t) for k in range(60) for i, t in enumerate(unequal(k))]
    got = {r.doc_id: r.class_id for r in M.near_classes(frame(spark, docs)).collect()}
    assert got == {i: i // 2 * 2 for i, _ in docs}
