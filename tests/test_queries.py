"""Every registered query runs on the smallest tables and agrees with its SQL."""

from __future__ import annotations

import os

import pytest

from tests.compare import compare, duck
from unitloom.plans.all import ORACLES, QUERIES

SF_DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, n, verdict = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert n > 0 and verdict in ("ok", "rows only"), verdict
