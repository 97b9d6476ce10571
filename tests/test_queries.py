"""Every registered query of the regional engine against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from wattlake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df, columns):
    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        if hasattr(x, "year"):
            return str(x)[:19].removesuffix(" 00:00:00")
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return round(float(x), 6)
        return str(x)

    return sorted((tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert rows(got, columns) == rows(want, columns)
