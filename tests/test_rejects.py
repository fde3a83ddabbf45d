"""Checked loading: what a file holds that its schema cannot take is counted and shown."""

import os
import tempfile

from pyspark.sql import types as T

from storelens.sources.tables import BAD_RECORD, BAD_TYPE, load_checked, load_table, unique_names

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("valor", T.DoubleType()),
        T.StructField("valor_2", T.IntegerType()),
        T.StructField("col_3", T.StringType()),
        T.StructField("ausente", T.StringType()),
    ]
)


def csv(text, name="t.csv"):
    path = os.path.join(tempfile.mkdtemp(prefix="storelens-test-"), name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_unique_names():
    assert unique_names(["a", "b", "a", "A", "a_2"]) == ["a", "b", "a_3", "A_4", "a_2"]
    assert unique_names([]) == []


def test_csv_rejects(spark):
    path = csv("id,valor,valor,\n1,2.5,7,x\nz,abc,8,y\n3,,9.5,\n4,1.0\n5,1.0,2,w,more\n")
    t = load_checked(spark, path, SCHEMA)
    rows = {r.id: r for r in t.rows.collect()}
    assert (rows[1].valor, rows[1].valor_2, rows[1].col_3, rows[1].ausente) == (2.5, 7, "x", None)
    assert rows[None].valor is None and rows[None].valor_2 == 8
    assert rows[3].valor is None and rows[3].valor_2 is None and rows[4].valor == 1.0 and rows[5].valor_2 == 2
    got = sorted(((r.coluna or "", r.motivo, r.valor) for r in t.rejects.collect()))
    assert got == [
        ("", BAD_RECORD, "4,1.0"),
        ("", BAD_RECORD, "5,1.0,2,w,more"),
        ("id", BAD_TYPE, "z"),
        ("valor", BAD_TYPE, "abc"),
        ("valor_2", BAD_TYPE, "9.5"),
    ]
    counts = {(r.coluna, r.motivo): (r.n, r.menor_valor) for r in t.counts().collect()}
    assert counts[(None, BAD_RECORD)] == (2, "4,1.0") and counts[("id", BAD_TYPE)] == (1, "z")
    assert t.missing == ("ausente",)


def test_clean_file_and_empty_file(spark):
    clean = load_checked(spark, csv("id,valor\n1,2\n"), SCHEMA)
    assert clean.rejects.count() == 0 and clean.missing == ("valor_2", "col_3", "ausente")
    assert [tuple(r) for r in clean.rows.collect()] == [(1, 2.0, None, None, None)]
    header_only = load_checked(spark, csv("id,valor,valor,\n"), SCHEMA)
    assert header_only.rows.count() == 0 and header_only.counts().count() == 0


def test_parquet_rejects(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="storelens-test-"), "t.parquet")
    spark.createDataFrame([("1", 2.0), ("x", None), (None, 3.0)], "id string, valor double").write.parquet(path)
    t = load_checked(spark, path, SCHEMA)
    assert [(r.coluna, r.motivo, r.valor) for r in t.rejects.collect()] == [("id", BAD_TYPE, "x")]
    key = lambda r: str(tuple(r))
    assert sorted(t.rows.collect(), key=key) == sorted(load_table(spark, path, SCHEMA).collect(), key=key)
