"""Driver contract and the oracle sweep on the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "receita_liquida" in df.columns


def test_every_sql_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    missing = set(E.QUERIES) - set(E.oracle_sql())  # the training-data queries have tests of their own
    assert missing == {"segmented_client_record"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


def canon(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        row = []
        for v in rec:
            if hasattr(v, "item"):
                v = v.item()
            if isinstance(v, float) and math.isnan(v):
                v = None
            row.append(v)
        out.append(repr(tuple(row)))
    return cols, sorted(out)


@pytest.mark.parametrize("key", sorted(E.SQL))
def test_oracle_matches(spark, duck, key):
    sp = E.queries()[key](spark, SF_SMALL).toPandas()
    dd = duck.execute(E.oracle_sql()[key]).df()
    assert canon(sp) == canon(dd)


def test_entry_works_without_the_libraries_of_the_extra_queries():
    """A missing library of the training-data queries takes only these away."""
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; sys.modules['regex'] = None; import __spark_entry__ as E; print(len(E.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.abspath(E.__file__)))
    assert out.returncode == 0 and int(out.stdout) == len(E.QUERIES)
