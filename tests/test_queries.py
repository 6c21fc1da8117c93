"""Every registered query of the library against its SQL in the other engine, on the smallest data."""

import datetime
import decimal
import os

import duckdb
import pytest

from snaplake import queries as registered

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
RUNS, SQL = registered.queries(), registered.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query(spark, other, name):
    got = RUNS[name](spark, DATA)
    mine = rows(got.columns, got.collect())
    if name in SQL:
        want = other.sql(SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert mine == rows(want.columns, want.fetchall())
    else:
        assert mine


def test_a_stream_over_many_files(spark, tmp_path, monkeypatch):
    """No task gathers the events, and their order is of no matter."""
    from snaplake.queries import lake_queries

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).sortWithinPartitions(events["ts"].desc()).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(lake_queries, "folder", lambda _: f"file://{tmp_path}/stream")
    got = RUNS["st_stream_watermark"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(SQL["st_stream_watermark"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    assert len(list((tmp_path / "stream" / "in").glob("*.parquet"))) > 1
