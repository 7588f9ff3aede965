import re

import duckdb
import pytest

import __spark_entry__ as contract
from lossweave.registry import ORACLE, QUERIES
from tools.check_oracle import TABLES, TYPES, rows_of

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "S2_sample_rows", "P2_labelled_document", "A1_quality_counters", "A11_dataset_hash", "M6_F9_filtered_by_example",
    "M2_filtered_nearest", "A9_W2_cluster_keywords", "A6_cluster_financials", "S12_J8_patch", "M15_T8_unusual_claims",
]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return db


def test_contract():
    assert set(ORACLE) <= set(QUERIES) <= set(contract.queries()) and ORACLE.items() <= contract.oracle_sql().items()
    assert not [n for n in QUERIES if re.match(r"op\d+_", n) or "pipeline" in n]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, SMALL), duck.sql(ORACLE[name])
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    assert rows_of(df.collect(), df.columns) == rows_of(rel.fetchall(), rel.columns)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
