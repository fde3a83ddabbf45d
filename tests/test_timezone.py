"""Results do not depend on the session time zone (timestamps are zone-free wall-clock values)."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL
from .test_entry import canon, duck  # noqa: F401  (module fixture)

DATE_KEYS = ["client_master", "recency_days", "client_record", "month_year_parts", "monthly_trend", "client_visits"]


@pytest.fixture(scope="module")
def dst_zone(spark):
    # a zone with midnight daylight-saving switches inside the test horizon (1999-2000)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("key", DATE_KEYS)
def test_same_result_in_a_dst_zone(dst_zone, duck, key):  # noqa: F811
    sp = E.queries()[key](dst_zone, SF_SMALL).toPandas()
    assert canon(sp) == canon(duck.execute(E.oracle_sql()[key]).df())
