import os

import pytest

from garimpo.llm import queries, sql
from oracle import SF, same


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, name):
    same(spark, queries.QUERIES[name], sql.SQL[name])
