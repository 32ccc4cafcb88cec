"""The operators' queries against their SQL on a second engine."""

import os

import pytest
from oracle import connect, differences

from quillstream.llm import registered

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query(spark, name):
    assert differences(spark, connect(DATA), registered.queries()[name], registered.oracle_sql()[name], DATA) is None
