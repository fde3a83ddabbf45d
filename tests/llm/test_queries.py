"""Registered queries: SQL where there is some, contract columns, and the pipeline against its stages' brute force."""

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as E
import corpus_pipeline as pipeline
from storelens.llm import bpe, queries, sql

from .helpers import frame, lowered, words
from .test_minhash import brute_classes, corpus

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op3_shard": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_mix_sources": "doc_id size source_size target taken",
    "op10_html_extract": "page_id url text n_chars",
    "op11_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op12_resample": "doc_id n_features weight score rank",
    "op13_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


def canon(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].convert_dtypes().astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert canon(queries.QUERIES[name](spark, SMALL).toPandas()) == canon(con.execute(sql.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "mix_sources", "bpe"]


def test_pipeline_stages(spark, tmp_path):
    raw = [(i, t, "ab"[i % 2], "en") for i, t in corpus(__import__("random").Random(8), 60)]
    raw += [(800, raw[0][1].upper(), "a", "en"), (801, None, "a", "en"), (802, "1234 !!", "b", None)]
    docs, given = frame(spark, raw), {r[0]: r for r in raw}
    out = []
    for name, stage in pipeline.STAGES:
        df = stage(spark, docs, SMALL)
        if name != "bpe":
            assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append([r.doc_id for r in docs.select("doc_id").collect()])
    told, exact, near, mixed, coded = out
    assert sorted(told) == sorted(i for i in given if i not in (801, 802))
    best = {}
    for i in told:
        best[lowered(given[i][1])] = max(best.get(lowered(given[i][1]), -1), i)
    assert sorted(exact) == sorted(best.values())
    assert sorted(near) == sorted(set(brute_classes([(i, given[i][1]) for i in exact]).values()))
    assert set(mixed) <= set(near) and max(map(mixed.count, mixed)) <= 2
    sizes = {s: sum(len(words(given[i][1])) for i in near if given[i][2] == s) for s in "ab"}
    taken = {s: sum(len(words(given[i][1])) for i in mixed if given[i][2] == s) for s in "ab"}
    assert 1.5 * sum(sizes.values()) - sum(taken.values()) <= 200 and all(taken[s] <= 2 * sizes[s] for s in "ab")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("o", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(f.read()), special_tokens={})
    for r in docs.collect():
        assert r.ids == library.encode_ordinary(given[r.doc_id][1])
    assert sorted(coded) == sorted(mixed) and np.isfinite(len(coded))


def test_pipeline_stages_on_edge_cases(spark):
    """Null ids, clashing columns and repeated rows go through every stage, and so does an empty table."""
    raw = [(i, t, "ab"[i % 2], "en") for i, t in corpus(__import__("random").Random(2), 12)]
    docs = frame(spark, [*raw, (None, raw[0][1] + " and more", None, None), raw[1], raw[1]])
    columns = docs.columns
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL).checkpoint()
        empty = stage(spark, empty, SMALL)
        assert name == "bpe" or docs.columns == columns == empty.columns
        assert empty.count() == 0 and docs.count() > 0
        empty = spark.createDataFrame([], docs.schema)


def test_rows_repeated_with_other_columns_are_picked_alike(spark):
    from storelens.llm import exact_dedup, minhash

    rows = [(1, "some words of a text that is repeated", s) for s in "abcdef"]
    for drop in (exact_dedup.drop_exact_copies, minhash.drop_near_copies):
        picked = {drop(frame(spark, order, parts)).collect()[0].source for order, parts in ((rows, 1), (rows[::-1], 3), (rows[3:] + rows[:3], 2))}
        assert len(picked) == 1
