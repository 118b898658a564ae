import os

import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, connect, rows_of, sql_rows


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(QUERIES[name](spark, DATA)) == sql_rows(connect(DATA), ORACLE_SQL[name])


def test_there_is_a_query_for_each_operator():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14))
