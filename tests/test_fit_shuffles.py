"""Shuffles are fitted to the rows of the tables: a task holds a bounded share of them, whatever the session's count."""

import duckdb
import pytest

import __spark_entry__ as E
from storelens import session
from storelens.sources.binding import bind_sales

from .conftest import SF_SMALL
from .test_entry import canon

PARTITIONS = "spark.sql.shuffle.partitions"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture()
def fitted(spark, monkeypatch):
    """The session with two shuffle partitions, fitted at 500 rows a partition; its settings come back."""
    keys = (PARTITIONS, ADVISORY, COALESCE, *BROADCAST)
    saved = {k: spark.conf.get(k, None) for k in keys}
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 500)
    monkeypatch.setattr(session, "COALESCE_TO", 16 << 10)
    spark.conf.set(PARTITIONS, "2")
    spark.conf.set(ADVISORY, "64MB")
    spark.conf.set(COALESCE, "false")  # these tables are far below what AQE puts together
    for k in BROADCAST:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_task_of_the_line_join_holds_a_bounded_share(fitted):
    lines = bind_sales(fitted, SF_SMALL)
    n = lines.count()
    parts = [len(p) for p in lines.select("pedido_id").rdd.glom().collect()]
    assert sum(parts) == n
    # two tasks held about half each before
    assert max(parts) <= 4 * session.ROWS_PER_PARTITION < n // 2


@pytest.mark.parametrize("key", ["client_master", "client_visits"])
def test_results_are_those_of_the_sql(fitted, key):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = E.queries()[key](fitted, SF_SMALL).toPandas()
    assert int(fitted.conf.get(PARTITIONS)) > 2
    assert canon(got) == canon(con.execute(E.oracle_sql()[key]).df())


def test_counts_are_only_raised_and_small_tables_change_nothing(fitted):
    assert session.fit_shuffles(fitted, 500) == 2
    assert (fitted.conf.get(PARTITIONS), fitted.conf.get(ADVISORY)) == ("2", "64MB")
    assert session.fit_shuffles(fitted, 5001) == 11
    assert session.fit_shuffles(fitted, 1001) == 11
    assert (fitted.conf.get(PARTITIONS), fitted.conf.get(ADVISORY)) == ("11", str(16 << 10))


@pytest.mark.parametrize(
    ("text", "size"), [("64MB", 64 << 20), ("67108864b", 64 << 20), ("16k", 16 << 10), ("16KB", 16 << 10), ("8m", 8 << 20), ("100", 100), ("1g", 1 << 30)]
)
def test_size_settings_are_read_as_spark_writes_them(text, size):
    assert session.size_bytes(text) == size
