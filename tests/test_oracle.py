"""Every registered query with SQL gives the SQL's rows."""

import os

import pytest

from flowspark import registry

from .compare import differ

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differ(spark, SF, registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
