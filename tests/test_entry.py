"""The driver contract, with or without the corpus operators."""

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["if_case", "nper", "lookup_asof", "cube_new_facts"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SMALL)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found.select(*columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)
