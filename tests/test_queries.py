"""Every registered core query that has SQL, against DuckDB on the smallest tables; the others under two partitionings."""

import datetime
import math
import os

import pytest

from tidemark.plans import registry

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Queries without SQL that start many jobs; they are covered by the kernels' tests and run by the driver.
LONG = {"bt_24_model_portfolio", "bt_10_blend_grid", "bt_16_rotation_grid", "bt_14_21_exit_sweep", "bt_15_core_and_lottery", "bt_6_7_slot_and_sleeve", "ml_1_boosted", "bt_9_tier_phases", "ml_11_15_candidates", "agg_15_bt_4_ablation_summary", "bt_1_single", "p1_grid", "p3_totals", "ml_7_stability", "sig_20_udf_6_registry", "sig_18_19_scan", "sig_17_verdict", "sig_13_14_band_router"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT":
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (datetime.date, datetime.datetime)) or hasattr(v, "isoformat"):
        return str(v).removesuffix(" 00:00:00")
    try:
        return repr(round(float(v), 7) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - LONG))
def test_same_rows_however_data_are_parted(spark, name):
    """What has no SQL must at least not depend on the number of partitions."""
    got = registry.queries()[name](spark, DATA).toPandas()
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = registry.queries()[name](spark, DATA).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len(got.columns) and list(got.columns) == list(again.columns)
    assert rows(got) == rows(again)
