import pytest
from skyfix.llm.queries import ORACLE_SQL, QUERIES

from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) is None
