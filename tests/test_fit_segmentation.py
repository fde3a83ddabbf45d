"""The client master written once for the segmentation queries, and what they make of it, with shuffles fitted to the tables."""

import duckdb
import pytest

import __spark_entry__ as E
from storelens.plans import registry as Q

from .conftest import SF_SMALL
from .test_entry import canon
from .test_fit_shuffles import PARTITIONS, fitted  # noqa: F401

ON_THE_MASTER = ["cluster_summary", "deep_pages", "standardize"]  # the sweep in test_entry.py has all of them, without the fitting


@pytest.mark.parametrize("step", [Q.labelled_master, Q.scaled_features])
def test_a_task_of_the_written_master_holds_a_bounded_share(fitted, step):  # noqa: F811
    m = Q.model(fitted, SF_SMALL)
    clients = m.clients.count()
    parts = [len(p) for p in step(m).select("cliente_id").rdd.glom().collect()]
    assert sum(parts) == clients
    # two tasks held about half each before
    assert max(parts) <= clients // 4


@pytest.mark.parametrize("key", ON_THE_MASTER)
def test_results_are_those_of_the_sql(fitted, key):  # noqa: F811
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = E.queries()[key](fitted, SF_SMALL).toPandas()
    assert int(fitted.conf.get(PARTITIONS)) > 2
    assert canon(got) == canon(con.execute(E.oracle_sql()[key]).df())
