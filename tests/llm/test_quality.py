from collections import Counter

from storelens.llm import quality as Q

from .helpers import frame, words


def brute(text):
    w, k = words(text), 8
    count = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    covered = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "x " * 40, "a b c d e f g h " * 3 + "end", "línea é\nlínea é\n\nother\nlínea é",
    "# * $ % & | < > plain", "the cat of the house and the dog " * 9, " ".join(f"w{i}" for i in range(3000)) + " w0 w1 w2 w3 w4 w5 w6 w7",
    "uno\x0bdos\x0ctres\rcuatro cinco", "SHOUT!! NOW!! " * 30, "tic tic tic tic tac tac tac tac " * 1 + "x1 x2 x3 x4 x5 x6 x7 x8 x9 y1 y2 y3 y4 y5",
]


def test_counts_equal_brute_force(spark):
    docs = list(enumerate(TEXTS))
    got = Q.quality_rules(frame(spark, docs + [docs[6]])).collect()
    assert len(got) == len(docs) + 1
    for r in got:
        n, chars, symbols, dup, repeat = brute(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r.doc_id
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert r.kept == (not r.failed_rules and not r.base_failed)


def test_clean_prose_is_kept_and_junk_is_not(spark):
    prose = "The house by the river was old and the people of the town " + " ".join(f"said word{i} to them" for i in range(30))
    docs = [(1, prose), (2, "&&& ### %%% $$$ " * 30 + prose), (3, "SHOUT!! NOW!! BUY!! " + " ".join(f"CHEAP{i}!!" for i in range(60)))]
    assert {r.doc_id: r.kept for r in Q.quality_rules(frame(spark, docs)).collect()} == {1: True, 2: False, 3: False}


def test_empty_table_and_native_plan(spark):
    df = Q.quality_rules(frame(spark, []))
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan
