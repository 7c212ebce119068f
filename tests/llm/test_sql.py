"""Every query of this package that SQL can state equals its SQL on the smallest tables."""

import pytest

from flowspark.llm import oracles, queries
from tests.compare import differ

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    assert differ(spark, SF, queries.QUERIES[name], oracles.ORACLE_SQL[name]) == ""
