import duckdb
import pytest

from tideframe.plans import catalog

D = "/root/testdata/sf0.001"


def plain(v):
    return v.isoformat() if hasattr(v, "isoformat") else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = duck.execute(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)


@pytest.mark.parametrize("name", ["window_join_sliding", "window_join_tumbling"])
def test_window_joins_read_times_as_their_sql(spark, tmp_path, name):
    """Parts of seconds next to the edges of windows, before 1970 too; null times and users."""
    edges = [f"'{day} {clock}'" for day in ("2024-01-01", "1969-12-31", "1970-01-01") for clock in ("03:59:59.5", "05:59:58.5", "05:59:59.499999", "05:59:59.5", "06:00:00.5", "07:59:59.999999", "11:59:59.7", "12:00:00", "20:00:00.2", "23:59:59.5")]
    c = duckdb.connect()
    c.execute(f"create table events as select row_number() over () as event_id, ts::timestamp as ts, u::bigint as user_id, k as event_type, 5.0 as value, '' as props from (select unnest([{', '.join(edges)}, null]) as ts), (values (1), (2), (null)) a(u), (values ('click'), ('view')) b(k)")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = catalog.queries()[name](spark, str(tmp_path)).select("o_id", "s_id", "w_start").collect()
    want = c.execute(catalog.oracle_sql()[name]).fetchall()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 76
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
