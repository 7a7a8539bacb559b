"""Every query with SQL gives the SQL's result on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference
from wellspring.plans import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKED = sorted(set(contract.oracle_sql()) & set(QUERIES))
# what a model learned cannot be foretold; the functions behind these are tested in test_learning and test_streams
WITHOUT_SQL = {
    "binary_forest_report",
    "isolation_forest_report",
    "model_comparison_report",
    "multiclass_forest_report",
    "stream_diagnoses",
    "telemetry_decisions",
    "top_importances",
    "well_disjoint_report",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_is_checked():
    assert set(QUERIES) - set(CHECKED) == WITHOUT_SQL


def test_entry(spark):
    assert contract.entry(spark).limit(5).count() == 5


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    assert difference(contract.queries()[name](spark, SF_DIR), duck, contract.oracle_sql()[name]) is None
