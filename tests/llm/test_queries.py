"""Queries that have SQL, against it, on whole tables."""

import os

import pytest

from girder.llm.registry import ORACLES, QUERIES
from tests.oracle import differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(spark, name, QUERIES[name], ORACLES[name], FOLDER) == []
