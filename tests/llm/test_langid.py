import math
import random
import zlib

import numpy as np
import pytest

from storelens.llm import langid as L

from .helpers import frame

SYLLABLES = {
    "aa": "ba ke lo mi tu", "bb": "sch ung lich zt ein", "cc": "ção ão nh lh es", "dd": "ski wicz prz czy ow",
}


def sample(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60)))
        out.append((i, text, "s", lang))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 9])
def test_codewords_are_apart(n):
    code = L.codewords(n)
    assert code.shape[0] == n
    if n > 1:
        distance = (code[:, None] != code[None]).sum(2) + np.eye(n, dtype=int) * 99
        assert distance.min() >= (1 if n == 2 else 2)
        assert ((code.sum(0) > 0) & (code.sum(0) < n)).all()


def test_held_out_documents_are_told(spark):
    docs = sample(400)
    got = L.identify(frame(spark, docs)).collect()
    lang = {d[0]: d[3] for d in docs}
    assert len(got) == 400
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) > 50


def test_only_training_rows_teach(spark):
    docs = sample(300)
    wrong = [(i, t, s, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, s, lang in docs]
    assert "xx" not in {r.lang_pred for r in L.identify(frame(spark, wrong)).collect()}


def test_undetermined_and_edge_cases(spark):
    docs = sample(200)
    odd = [(1000, None, "s", "aa"), (1001, "", "s", None), (1002, "12 34 !", "s", "aa"), (None, docs[0][1], None, docs[0][3]),
           (1003, docs[1][1] * 3000, "s", None), (1003, docs[1][1] * 3000, "s", None)]
    got = L.identify(frame(spark, docs + odd)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0.0 for i in (1000, 1001, 1002))
    assert by[None][0].lang_pred == docs[0][3] and {r.lang_pred for r in by[1003]} == {docs[1][3]} and len(by[1003]) == 2
    assert L.identify(frame(spark, [])).collect() == []
    unlabelled = L.identify(frame(spark, [(1, "text"), (2, "more")])).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_kept_documents(spark):
    docs = frame(spark, sample(200) + [(1000, None), (1001, "12 34")])
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(200))


def test_trigrams_of_long_texts_in_parts(monkeypatch):
    text = "abc déf " * 700_000
    whole = L.trigrams(text)
    assert whole.sum() == len((" " + " ".join(text.split()) + " ").encode()) - 2


def test_ambiguous_texts_are_flagged(spark):
    model = L.train(frame(spark, sample(400)))
    counts = [L.trigrams(t) for t in ("ba ke lo mi tu", "sch ung lich zt ein")]
    lang, score, unsure = model.decode(np.array(counts))
    assert lang == ["aa", "bb"] and not unsure.any() and (score > 0.5).all()
    equal = L.Model(model.languages, model.code, 0 * model.odds, model.scale, 0 * model.shift, np.ones(model.code.shape))
    assert equal.decode(np.array(counts))[2].all()


def plain_trigrams(text):
    """Counts of hashed trigrams, one byte at a time."""
    data = (" " + " ".join(text.lower().split()) + " ").encode()
    out = {}
    for i in range(len(data) - 2):
        f = ((data[i] + (data[i + 1] << 8) + (data[i + 2] << 16)) * 2654435761 % 2**32) >> 19
        out[f] = out.get(f, 0) + 1
    return out


def plain_fit(xs, ys):
    """Scale and shift of the ridge logistic regression of ys on the standardised xs, by scalar Newton steps."""
    mean = sum(xs) / len(xs)
    dev = math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs))
    a = b = 0.0
    for _ in range(25):
        haa, hab, hbb, ga, gb = 0.1, 0.0, 0.1, -0.1 * a, -0.1 * b
        for x, y in zip(xs, ys, strict=True):
            z = (x - mean) / dev
            p = 1 / (1 + math.exp(-(a * z + b)))
            w = p * (1 - p)
            haa, hab, hbb, ga, gb = haa + w * z * z, hab + w * z, hbb + w, ga + z * (y - p), gb + y - p
        det = haa * hbb - hab * hab
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return a / dev, b - a * mean / dev


def plain_language_id(docs):
    """Language and score of every document, recomputed without numpy from the definition."""
    train = [(t, lang) for i, t, _, lang in docs if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5]
    langs = sorted({lang for _, lang in train})
    share = []
    for lang in langs:
        row = [0.0] * L.FEATURES
        for t, other in train:
            if other == lang:
                counts = plain_trigrams(t)
                for f, c in counts.items():
                    row[f] += c / math.sqrt(sum(counts.values()))
        total = sum(round(x, 6) + 0.5 for x in row)
        share.append([(round(x, 6) + 0.5) / total for x in row])
    code = L.codewords(len(langs)).tolist()
    bits = range(len(code[0]))
    odds = []
    for j in bits:
        sides = [[share[i] for i in range(len(langs)) if code[i][j] == side] for side in (1, 0)]
        odds.append([math.log(sum(r[f] for r in sides[0]) / len(sides[0])) - math.log(sum(r[f] for r in sides[1]) / len(sides[1])) for f in range(L.FEATURES)])

    def raw(text):
        counts = plain_trigrams(text)
        return [sum(c * odds[j][f] for f, c in counts.items()) / sum(counts.values()) for j in bits]

    margins = [raw(t) for t, _ in train]
    own = [langs.index(lang) for _, lang in train]
    fit = [plain_fit([m[j] for m in margins], [code[i][j] for i in own]) for j in bits]

    def scaled(m):
        return [m[j] * fit[j][0] + fit[j][1] for j in bits]

    weight = []
    for i in range(len(langs)):
        mine = [scaled(m) for m, k in zip(margins, own, strict=True) if k == i]
        weight.append([max(sum((m[j] > 0) == (code[i][j] == 1) for m in mine) / len(mine), 0.01) for j in bits])
    out = {}
    for doc_id, text, _, _ in docs:
        m = scaled(raw(text))
        loss = [
            sum(weight[i][j] * math.log1p(math.exp(-m[j] if code[i][j] else m[j])) for j in bits) / sum(weight[i]) * len(bits)
            for i in range(len(langs))
        ]
        e = [math.exp(min(loss) - x) for x in loss]
        order = sorted((x / sum(e) for x in e), reverse=True)
        out[doc_id] = (langs[loss.index(min(loss))], order[0], order[0] - order[1] < L.CLEAR)
    return out


def test_equals_brute_force(spark):
    """Counts, log-odds, bit fits, weights and decoding recomputed; texts of mixed languages are between two."""
    docs = sample(160, seed=3)
    docs += [(1000 + i, a[1][: 20 + 3 * i] + " " + b[1][:40], "s", None) for i, (a, b) in enumerate(zip(docs, docs[1:41], strict=False))]
    want = plain_language_id(docs)
    got = L.identify(frame(spark, docs)).collect()
    assert len(got) == len(want) == 200
    for r in got:
        lang, score, unsure = want[r.doc_id]
        assert abs(r.score - score) < 1e-6
        if abs(score - 0.5) > 1e-6:
            assert r.lang_pred == lang
        assert r.ambiguous == unsure
