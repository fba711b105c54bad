"""A sample of registered queries compared with their DuckDB twins on the
smallest tables (the full comparison is tools/check_oracle.py)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import close, rows_of  # noqa: E402
from lakesmith.sources.tables import TABLES  # noqa: E402

SAMPLE = ["ag_02", "cln_07", "jn_05", "wn_01", "pr_03", "pr_11", "dq_06", "dq_12", "wh_03", "wh_11",
          "st_03", "st_04", "ml_14", "ml_15", "ts_01", "txt_02", "vec_02", "cor_05", "ins_01", "snk_03"]


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql_twin(spark, sf_small, duck, name):
    sc, sr = rows_of(E.queries()[name](spark, sf_small).toPandas())
    dc, dr = rows_of(duck.execute(E.oracle_sql()[name]).df())
    assert sc == dc and len(sr) == len(dr)
    assert all(close(a, b) for a, b in zip(sr, dr))
