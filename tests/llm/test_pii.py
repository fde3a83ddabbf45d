"""Personal data: base spans against the plain patterns, EM against a row-by-row recomputation, and planted cases."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from storelens.llm import pii

from .helpers import frame, rows_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def base(text):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(only(m)) <= 19 and luhn(only(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only(m)) <= 15]


def found(text):
    return [(pii.KINDS[k], s, e) for k, s, e, passed in pii.base_matches(text) if passed]


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(4)
    pieces = ["a@b.c", "x.y+z", "@", ".", "-", " ", "+", "(", ")", "4111111111111111", "12", "255.1", "300", "1.2.3.4", "é", "@x-.q", "_",
              "+49 30 1234567", "4111 1111 1111 1111", "0000000000000000", "\n", "b.c", "%", "5555-5555-5555-4444", "7"]
    for _ in range(20_000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14)))
        assert found(text) == base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 400_000, "a@" * 300_000, "+1" * 300_000, "1 " * 400_000, "a at b dot " * 50_000):
        pii.find(text)
    assert len(pii.find("a@b.cd 10.0.0.1 " * 20_000)) == 40_000


@pytest.mark.parametrize(
    "text, span",
    [
        ("4000 0000 0000 0002 4111 1111 1111 1111", "4111 1111 1111 1111"),
        ("7536784127813050 4845168114407329", "4845168114407329"),
        ("call +1 (826) 555-4081 190.137.223.204 now", "+1 (826) 555-4081"),
        ("write to jane.doe (at) example (dot) com please", "jane.doe (at) example (dot) com"),
        ("mail josé@exämple.org", "josé@exämple.org"),
        ("host 2001:db8:0:0:8:800:200c:417a up", "2001:db8:0:0:8:800:200c:417a"),
        ("phone (017) 555-7713 now", "(017) 555-7713"),
    ],
)
def test_candidates_beyond_the_base(text, span):
    spans = [text[s:e] for _, s, e, is_base, *_ in pii.find(text) if not is_base]
    assert span in spans


def corpus():
    rows = []
    for i in range(60):
        rows.append((i, f"plain words here and more words {i} mail a{i}@mail.example.com or +1 (555) 555-{1000 + i} at 10.1.2.{i} ok"))
    for i in range(60, 100):
        rows.append((i, f"some text 958244292100{2300 + i} and version 1.2.{i}.999 with order no 7536784127813{100 + i}"))
    rows += [(200, None), (201, ""), (202, "no data at all"), (None, "mail x@y.org"), (203, "pay 7536784127813050 4845168114407329 now")]
    rows += [(204, "so +1 (826) 555-4081 190.137.223.204 du"), (205, rows[3][1]), (206, "x" * 200_000 + " z@y.net " + "é " * 30_000)]
    return rows


def test_result(spark):
    rows = corpus()
    got = {r.doc_id: r for r in pii.find_personal(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = base(text or "")
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in want) for k in pii.KINDS)
        assert r.base_sha256 == sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest()
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(want) <= set(spans) and r.n_added == len(spans) - len(want)
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        if i is not None and (i < 203 or i > 204):
            assert r.n_added == 0, (text, r.spans)
    text = dict(rows)
    added = lambda i: [text[i][int(s) : int(e)] for _, s, e in (x.split(":") for x in got[i].spans.split(","))]
    assert "4845168114407329" in added(203)
    assert "+1 (826) 555-4081" in added(204)


def test_empty_table_and_repeated_rows(spark):
    rows = [(1, "a@b.org"), (1, "a@b.org"), (2, "")]
    assert rows_of(pii.find_personal(frame(spark, rows).limit(0))) == []
    assert [r.n_email for r in pii.find_personal(frame(spark, rows)).orderBy("doc_id").collect()] == [1, 1, 0]


def test_em_equals_row_by_row(spark):
    """Counts of patterns give what the same EM gives span by span."""
    rnd = random.Random(2)
    spans = [(rnd.randrange(4), rnd.random() < 0.4, "".join(rnd.choice("+-0") for _ in pii.LABELERS)) for _ in range(300)]
    counts = {}
    for s in spans:
        counts[s] = counts.get(s, 0) + 1
    fitted = pii.fit_reliabilities([(*s, n) for s, n in counts.items()])
    for kind in range(4):
        mine = [(b, v) for k, b, v in spans if k == kind]
        right = [8, 98, 8, 8, 8, 8]
        share, yes = 0.5, [[r / (r + 2) for r in right], [2 / (r + 2) for r in right]]
        for _ in range(pii.STEPS):
            true = []
            for known, votes in mine:
                odds = np.log(share / (1 - share))
                for j, c in enumerate(votes):
                    if c != "0":
                        a, b = (yes[0][j], yes[1][j]) if c == "+" else (1 - yes[0][j], 1 - yes[1][j])
                        odds += np.log(a / b)
                true.append(1.0 if known else 1 / (1 + np.exp(-odds)))
            for side in (0, 1):
                for j in range(6):
                    plus = sum((t if side == 0 else 1 - t) for t, (_, v) in zip(true, mine, strict=True) if v[j] == "+")
                    minus = sum((t if side == 0 else 1 - t) for t, (_, v) in zip(true, mine, strict=True) if v[j] == "-")
                    yes[side][j] = (plus + (right[j] if side == 0 else 2)) / (plus + minus + right[j] + 2)
            loose = [t for t, (known, _) in zip(true, mine, strict=True) if not known]
            share = (sum(loose) + 2) / (len(loose) + 4)
        assert np.allclose(fitted.yes[kind], yes) and np.isclose(fitted.share[kind], share)


def test_em_finds_the_reliable_labeler():
    """A labeler that tells true from false gets high reliability, one that guesses does not."""
    rnd = random.Random(9)
    counts = {}
    for _ in range(4000):
        true, known = rnd.random() < 0.5, rnd.random() < 0.3
        good = true if rnd.random() < 0.95 else not true
        votes = "".join("+" if x else "-" for x in (good, good if rnd.random() < 0.9 else not good, rnd.random() < 0.5)) + "000"
        key = (2, true and known, votes)
        counts[key] = counts.get(key, 0) + 1
    fitted = pii.fit_reliabilities([(*k, n) for k, n in counts.items()])
    assert fitted.yes[2, 0, 0] > 0.9 and fitted.yes[2, 1, 0] < 0.1 and abs(fitted.yes[2, 0, 2] - fitted.yes[2, 1, 2]) < 0.1


def test_classifier_learns_soft_labels():
    rnd = np.random.default_rng(1)
    votes = rnd.choice([-1.0, 0.0, 1.0], (500, 6))
    features = np.concatenate([rnd.integers(0, 5, (500, pii.SHAPES)), rnd.integers(0, pii.WORD_BUCKETS, (500, 2))], 1)
    true = 1 / (1 + np.exp(-3 * votes[:, 1]))
    w = pii.fit_classifier(votes, features, true)
    p = 1 / (1 + np.exp(-pii.vectors(votes, features) @ w))
    assert np.corrcoef(p, true)[0, 1] > 0.95
    none = pii.fit_classifier(np.zeros((0, 6)), np.zeros((0, pii.SHAPES + 2), dtype=int), np.zeros(0))
    ends = pii.vectors(np.array([[1.0] * 6, [-1.0] * 6]), np.zeros((2, pii.SHAPES + 2), dtype=int)) @ none
    assert ends[0] > 0 > ends[1]
