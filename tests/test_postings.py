"""Trigram postings: every search equals the scan."""

import random

import pytest
from pyspark.sql import functions as F

from storelens.operators import explore as E
from storelens.operators import postings as PI
from storelens.session import shared_scope

COLS = ("nome", "cidade", "id")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abçÉé 😀A", k=rng.randint(0, 14)))
    data = [(i if i % 50 else None, None if i % 13 == 0 else word(), word() if i % 3 else "são paulo") for i in range(600)]
    data += [(7, "twice the same id", "x"), (7, "twice the same id", "x"), (900, "ababababab", "baba"), (901, "a" * 50_000 + "fim", "")]
    return spark.createDataFrame(data, "id long, nome string, cidade string").cache()


@pytest.fixture(scope="module")
def index(spark, rows):
    with shared_scope(spark):
        yield PI.build_index(rows, "id", COLS)


def canon(df):
    return sorted(map(str, df.collect()))


TEXTS = ["", "  ", "a", "ab", "aba", "abab", " ÉÉ ", "são", "SÃO PAULO", "twice the sa", "aafim", "99", "900", "😀", "b😀a", "no such one!"]


@pytest.mark.parametrize("q", TEXTS)
def test_search_equals_the_scan(rows, index, q):
    assert canon(index.search(q)) == canon(E.text_search(rows, q, COLS))


@pytest.mark.parametrize("n", range(1, 13))
def test_texts_of_every_length(rows, index, n):
    rng = random.Random(n)
    texts = [r.nome for r in rows.where(F.char_length("nome") >= n).orderBy("nome", "id").limit(200).collect()]
    text = rng.choice(texts)
    at = rng.randrange(len(text) - n + 1) if len(text) < 1000 else 0
    q = text[at : at + n]
    assert canon(index.search(q)) == canon(E.text_search(rows, q, COLS))


def test_trigrams_of_unlike_columns_are_no_find(spark):
    """'abcd' needs abc and bcd; a row that has them in two columns is a candidate, but not found."""
    split = spark.createDataFrame([(1, "xabc", "bcdx"), (2, "xabcd", "")], "id long, nome string, cidade string")
    index = PI.PostingIndex(split, PI.postings(split, "id", COLS), "id", COLS)
    assert sorted(r._id for r in index.candidates("abcd").collect()) == [1, 2]
    assert [r.id for r in index.search("abcd").collect()] == [2]


def test_a_search_reads_its_trigrams(index):
    plan = index.candidates("abab")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(trigrama, [aba,bab])" in plan


def test_empty_table(spark, rows):
    none = rows.limit(0)
    index = PI.PostingIndex(none, PI.postings(none, "id", COLS), "id", COLS)
    assert index.search("abc").count() == 0 and index.search("").count() == 0


def test_tasks_follow_the_rows_not_the_files(spark, monkeypatch):
    """Rows of one partition (one small file) are taken apart by many tasks, and the postings lie in many ranges."""
    monkeypatch.setattr(PI, "ROWS_PER_TASK", 50)
    one = spark.range(0, 600, 1, 1).select(
        F.when(F.col("id") % 50 != 0, F.col("id") % 550).alias("id"),
        F.concat(F.lit("nome "), F.hex("id")).alias("nome"),
        F.when(F.col("id") % 3 != 0, F.lit("são paulo")).alias("cidade"),
    )
    with shared_scope(spark):
        index = PI.build_index(one, "id", COLS)
        assert len(index.postings.inputFiles()) > 8  # 600 rows: 12 ranges; the session's 8 before
        assert canon(index.postings) == canon(PI.postings(one, "id", COLS))
        assert canon(index.search("são")) == canon(E.text_search(one, "são", COLS))
