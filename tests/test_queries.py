"""Every query against its SQL counterpart, and the registration without the optional subpackage."""

import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from rollcall.plans.oracles import oracle_sql
from rollcall.plans.queries import QUERIES
from tests.conftest import ROOT, SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = oracle_sql()


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        pd.testing.assert_frame_equal(plain(got), plain(duck.execute(ORACLES[name]).df()))
    else:
        assert len(got)


def test_registration_without_the_optional_part():
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith('rollcall.llm') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
