"""Month-by-month client rollup: equal to one build, and only the given months are written."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from storelens.operators import rollup_state as RS
from storelens.operators import rollups as R


def canon(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def files(path):
    return {
        (d.split(os.sep)[-1], f)
        for d, _, names in os.walk(path)
        for f in names
        if f.endswith(".parquet") and "mes_ref=" in d
    }


@pytest.fixture(scope="module")
def sales(spark):
    """Lines of four months and of none; client 1 holds a third, an order spans two months, a client is missing."""
    rows = []
    for i in range(400):
        m = [1, 2, 3, 4, None][i % 5]
        rows.append(
            (
                1 if i % 3 == 0 else (None if i % 41 == 0 else i % 17), None if i % 29 == 0 else i // 3, i % 13,
                None if m is None else f"2020-0{m}", None if m is None else datetime(2020, m, 1 + i % 28),
                float(i), i * 0.5, *[f"{i}.25"] * 5,
            )
        )
    df = spark.createDataFrame(
        rows,
        "cliente_id long, pedido_id long, sku_id long, mes_ref string, data_pedido timestamp_ntz, quantidade double, volume_kg double, "
        "receita_bruta string, receita_liquida string, desconto string, custo_total string, margem_contribuicao string",
    )
    return df.withColumns({c: F.col(c).cast("decimal(18,4)") for c in R._SUMS}).cache()


@pytest.fixture
def path():
    return os.path.join(tempfile.mkdtemp(prefix="storelens-test-"), "state")


def test_one_build(spark, sales, path):
    schema = RS.write_state(sales, path)
    assert canon(RS.client_sales_from_state(RS.read_state(spark, path, schema))) == canon(R.client_sales(sales))


def test_month_by_month(spark, sales, path):
    schema = RS.write_state(sales.limit(0), path)
    for month in ["2020-03", None, "2020-01", "2020-04", "2020-02"]:
        assert RS.update_months(sales, [month], path) == []
    assert canon(RS.client_sales_from_state(RS.read_state(spark, path, schema))) == canon(R.client_sales(sales))


def test_update_rewrites_one_month(spark, sales, path):
    schema = RS.write_state(sales, path)
    before = files(path)
    corrected = sales.withColumn("quantidade", F.when(F.col("mes_ref") == "2020-02", F.lit(1.0)).otherwise(F.col("quantidade")))
    RS.update_months(corrected, ["2020-02"], path)
    after = files(path)
    assert {d for d, _ in before ^ after} == {"mes_ref=2020-02"}
    want = canon(R.client_sales(corrected))
    assert canon(RS.client_sales_from_state(RS.read_state(spark, path, schema))) == want
    RS.update_months(corrected, ["2020-02", "2020-02"], path)  # again: the same state
    assert canon(RS.client_sales_from_state(RS.read_state(spark, path, schema))) == want


def test_emptied_month_goes(spark, sales, path):
    schema = RS.write_state(sales, path)
    left = sales.where("mes_ref is not null and mes_ref != '2020-04'")
    assert RS.update_months(left, ["2020-04", None, "2031-01"], path) == ["2020-04", None]
    assert canon(RS.client_sales_from_state(RS.read_state(spark, path, schema))) == canon(R.client_sales(left))
