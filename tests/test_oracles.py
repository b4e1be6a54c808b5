"""Every query against its DuckDB oracle on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from broadsheet.queries import ORACLES, QUERIES

# Rows differ between the engines only where a model is fitted; see test_classify.
NO_ORACLE = {"model_quality"}
# The small table does not hold enough text for the oracle's claim of perfect recall.
ONLY_ON_LARGER = {"train_predict"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = connect(sf_dir)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - ONLY_ON_LARGER))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    same, line = compare(spark, duck, name, QUERIES[name], ORACLES[name], sf_dir)
    assert same, line


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE


def test_entry_runs(spark, sf_dir):
    rows = contract.entry(spark)
    assert rows.columns == ["host", "n_links", "n_titles"]
    assert rows.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
