from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, _rows

SF = "/root/testdata/sf0.001"
SAMPLE = ["wn1_prefix", "wn6_rebalanced_split", "ag5_abnormality", "hm9_filter", "hm8_viterbi", "hm4_expectation", "st5_bootstrap_rho", "st12_leave_one_arm_out"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared test tables")


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, result.fetchall())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
