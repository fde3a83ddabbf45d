"""Sources and sinks: loader, numeric coercion, JSON and CSV round trips."""

import os
import tempfile

from pyspark.sql import types as T

from storelens.plans.output import as_output
from storelens.sources import sinks
from storelens.sources.tables import coerce_numeric, header_names, load_table


def test_header_names():
    assert header_names(["a", None, "c", ""]) == ["a", "col_1", "c", "col_3"]


def test_load_table_csv_with_schema_and_blank_header(spark):
    d = tempfile.mkdtemp(prefix="storelens-test-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write("id,,valor\n1,x,2.5\n2,y,abc\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("col_1", T.StringType()), T.StructField("valor", T.DoubleType()), T.StructField("ausente", T.StringType())])
    rows = load_table(spark, p, schema).orderBy("id").collect()
    assert [(r.id, r.col_1, r.valor, r.ausente) for r in rows] == [(1, "x", 2.5, None), (2, "y", None, None)]


def test_coerce_numeric(spark):
    df = spark.createDataFrame([("1.5", "a"), ("x", "2")], "a string, b string")
    assert [(r.a, r.b) for r in coerce_numeric(df, ["a", "b"]).collect()] == [(1.5, None), (None, 2.0)]


def test_csv_sink_round_trip(spark):
    rec = spark.createDataFrame(
        [(1, 'Loja "A"', "C", "P", "Rio", "RJ", "SE", 3, "Seg", 10.5, 20.0, 2, 5, 3)],
        "id long, nome string, canal string, porte string, cidade string, uf string, regiao string, vendedor_id long, "
        "cluster_nome string, rec_liq double, margem_pct double, pedidos long, recencia_dias long, skus long",
    )
    path = os.path.join(tempfile.mkdtemp(prefix="storelens-test-"), "csv")
    sinks.write_clients_csv(rec, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert back.columns == [h for _, h in sinks.CSV_COLUMNS]
    row = back.collect()[0]
    assert row.Nome == 'Loja "A"' and row.Receita_Liquida == "10.5"
    # one row over several partitions: the other part files are empty, pick the one holding it
    texts = [open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.endswith(".csv")]
    (text,) = [t for t in texts if len(t.splitlines()) > 1]
    assert text.splitlines()[1].startswith('"1","Loja')


def test_json_sections(spark, model_small):
    from storelens.operators import rollups as R

    m = model_small
    trend = as_output(R.monthly_trend(R.billed_sales(m.sales, m.horizon.billed_status)))
    base = tempfile.mkdtemp(prefix="storelens-test-")
    paths = sinks.write_sections({"temporal": trend}, base)
    back = spark.read.json(paths["temporal"])
    assert back.count() == trend.count() == 80


def test_scale_conf_sizes_partitions_from_input():
    from storelens.session import scale_conf

    small = scale_conf(10 << 20)
    assert small["spark.sql.shuffle.partitions"] == "200"
    big = scale_conf(100 * 10**12)
    assert int(big["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    assert int(big["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"]) == 4 * (256 << 20)


def test_apply_unset_keeps_explicit_settings(spark):
    from storelens.session import apply_unset

    before = spark.conf.get("spark.sql.shuffle.partitions")  # set explicitly by the test session
    applied = apply_unset(spark, {"spark.sql.shuffle.partitions": "999"})
    assert "spark.sql.shuffle.partitions" not in applied
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_scopes_nest_and_belong_to_their_thread(spark):
    import threading

    from storelens.session import shared_scope, write_shared

    with shared_scope(spark) as outer:
        with shared_scope(spark) as inner:
            pass  # both still empty
        kept = write_shared(spark.range(3), "t")
        assert len(outer) == 1 and inner == []
        seen = []
        thread = threading.Thread(target=lambda: seen.append(write_shared(spark.range(2), "u").count()))
        thread.start()
        thread.join()
        assert seen == [2] and len(outer) == 1
        assert kept.count() == 3
