"""Queries whose whole result SQL can express."""

import duckdb
import pandas as pd
import pytest

from rollcall.llm.queries import oracle_sql, queries
from tests.test_queries import TABLES, plain


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    pd.testing.assert_frame_equal(plain(queries()[name](spark, small).toPandas()), plain(con.execute(oracle_sql()[name]).df()))
