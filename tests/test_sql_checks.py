"""Every registered query against its SQL, over the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from bundleflow.suite.all import CASES, FLAGSHIP
from tools.check_sql import compare, connect

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(CASES))
def test_query(spark, con, data_dir, name):
    verdict = compare(spark, con, data_dir, name, QUERIES[name], CHECKS.get(name))
    assert not verdict.startswith("FAIL"), verdict


def test_contract():
    assert set(CHECKS) <= set(QUERIES)
    assert set(CASES) <= set(QUERIES)
    assert FLAGSHIP in QUERIES


def test_entry_runs(spark, data_dir):
    assert os.path.isdir(data_dir)
    assert entry.entry(spark).count() > 0
