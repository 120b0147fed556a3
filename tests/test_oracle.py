"""Every registered query against its SQL on the smallest tables."""

import pytest

from check import compare
from panelspark.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"

# Too few rows on the smallest tables for class-complete folds would raise.
ROWS_ONLY = [n for n in QUERIES if n not in ORACLE]


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, name):
    problem = compare(spark, SF, QUERIES[name], ORACLE[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(c for c in df.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
