import pytest

from lexstrata.llm.queries import ORACLES, QUERIES

from ..compare import oracle_rows, spark_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    got, want = spark_rows(QUERIES[name](spark, SF)), oracle_rows(ORACLES[name], SF)
    assert got == want and got[1]
