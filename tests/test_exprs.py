"""Edge-case goldens for the column builders (hand-worked small frames)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storelens import params as P
from storelens.functions import exprs as X
from storelens.operators import masters as M


def one_col(spark, values, typ="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_duration_band_is_right_closed(spark):
    df = one_col(spark, [0.0, 0.5, 15.0, 15.01, 90.0, 180.0, 180.5, None])
    got = [r[0] for r in df.select(X.band("x", P.DURATION_EDGES, P.DURATION_LABELS)).collect()]
    assert got == [None, "0-15 min", "0-15 min", "16-30 min", "61-90 min", "90+ min", None, None]


def test_discount_band_edges(spark):
    df = one_col(spark, [-0.02, -0.01, -0.005, 0.0, 0.03, 0.031, 0.25, 0.2501, 1.0, 1.5])
    got = [r[0] for r in df.select(X.band("x", P.DISCOUNT_EDGES, P.DISCOUNT_LABELS)).collect()]
    assert got == [
        None,
        None,
        "0% (Sem desconto)",
        "0% (Sem desconto)",
        "0.1% a 3%",
        "3.1% a 6%",
        "15.1% a 25%",
        "> 25%",
        "> 25%",
        None,
    ]


def test_band_rejects_bad_edges():
    with pytest.raises(ValueError):
        X.band("x", (0, 1), ("a", "b"))


def test_safe_ratio_and_nonzero_den(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (3.0, -1.0)], "n double, d double")
    got = df.select(X.safe_ratio("n", "d").alias("a"), X.ratio_nonzero_den("n", "d").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(0.0, 1.0), (0.25, 0.25), (0.0, -3.0)]


def test_try_ratio_is_null_on_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "n double, d double")
    assert [r[0] for r in df.select(X.try_ratio("n", "d")).collect()] == [None, 0.5]


def test_recency_floors_elapsed_seconds(spark):
    rows = [(dt.datetime(2000, 12, 30, 10, 0),), (dt.datetime(2000, 12, 30, 0, 0),), (None,), (dt.datetime(2001, 1, 1, 12),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r[0] for r in df.select(X.recency_days("ts", "2000-12-31")).collect()]
    # 14 h → 0 days (a calendar diff would say 1); never bought → 999; future → -2 (floor)
    assert got == [0, 1, 999, -2]


def test_yoy_growth_branches(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0), (10.0, 15.0), (10.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(X.yoy_growth("a", "b")).collect()] == [1.0, 0.0, 0.5, -1.0]


def test_seller_quadrant_branches(spark):
    df = spark.createDataFrame(
        [(1.2, 0.3, 0.25), (1.0, 0.2, 0.25), (0.5, 0.25, 0.25), (0.5, 0.1, 0.25)], "a double, m double, t double"
    )
    got = [r[0] for r in df.select(X.seller_quadrant("a", "m", "t")).collect()]
    assert got == [P.QUADRANT_STAR, P.QUADRANT_VOLUME, P.QUADRANT_PROFITABLE, P.QUADRANT_CRITICAL]


def test_round_half_up_avoids_binary_ties(spark):
    df = one_col(spark, [2.675, 1.005, 0.125, -2.675])
    assert [r[0] for r in df.select(X.round_half_up("x", 2)).collect()] == [2.68, 1.01, 0.13, -2.68]


def test_status_band_and_light(spark):
    df = one_col(spark, [25.0, 24.99, 20.0, 19.99])
    assert [r[0] for r in df.select(X.status_band("x")).collect()] == ["good", "warn", "warn", "bad"]
    s = spark.createDataFrame([(100.0, 25.0, 25.0), (100.0, 20.0, 25.0), (99.9, 30.0, 25.0)], "a double, m double, t double")
    assert [r[0] for r in s.select(X.seller_light("a", "m", "t")).collect()] == ["green", "amber", "red"]


def test_clamp_score(spark):
    df = one_col(spark, [0.0, 600.0, 2400.0])
    assert [r[0] for r in df.select(X.clamp_score("x", 1200.0)).collect()] == [0.0, 50.0, 100.0]
    assert [r[0] for r in df.select(X.clamp_score("x", 300.0, invert=True)).collect()] == [100.0, 0.0, 0.0]


def test_fill_metrics_keeps_text_null(spark):
    """Only metric columns are 0-filled; a missing substitute SKU stays NULL (never '0')."""
    df = spark.createDataFrame([(1, None, None)], "sku_id long, receita_total decimal(38,4), substituto_sku_id string")
    row = M.fill_metrics(df, ["receita_total"]).collect()[0]
    assert float(row.receita_total) == 0.0 and row.substituto_sku_id is None


def test_date_text(spark):
    df = spark.createDataFrame([(dt.datetime(2000, 1, 2, 3, 4),), (None,)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(X.date_text("ts")).collect()] == ["2000-01-02", ""]


def test_money_sum_of_no_rows_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "k long, v decimal(18,2)")
    row = df.groupBy("k").agg(X.money_sum("v").alias("s")).collect()[0]
    assert float(row.s) == 0.0
    assert df.where(F.lit(False)).agg(X.money_sum("v")).collect()[0][0] == 0
