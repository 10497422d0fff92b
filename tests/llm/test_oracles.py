"""The queries of the numbered operators against their SQL, and all of them for the columns they promise."""

import pytest
from compare import compare

from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], SF) is None
