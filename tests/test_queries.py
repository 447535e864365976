"""Every registered query of the engine against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from pairwright import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and v != v else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sql, name):
    df = catalog.queries()[name](spark, FOLDER)
    want = sql.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_whole_panels_leave_out_no_unit(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    units = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_type").distinct()
    for name in ("w_holm", "w_holm_declared"):
        out = catalog.queries()[name](spark, folder)
        assert out.count() == units.count() and out.where("user_id >= 40").count() > 0


def test_reports_and_calls_leave_out_no_row(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    users = spark.read.parquet(f"{folder}/events.parquet").select("user_id").distinct().count()
    assert catalog.queries()["k_report_table"](spark, folder).count() == users > 50
    said = spark.read.parquet(f"{folder}/conversations.parquet").where("role = 'user'").count()
    assert catalog.queries()["s_provider_rows"](spark, folder).count() == said
