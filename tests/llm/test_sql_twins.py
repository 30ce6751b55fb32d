"""The registered queries that SQL can express, on small tables."""

import pytest

from marketloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    same_rows(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)
