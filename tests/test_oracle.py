import os

import pytest

from garimpo.queries import core_queries, core_sql
from oracle import SF, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(core_sql()))
def test_query_equals_sql(spark, name):
    same(spark, core_queries()[name], core_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core_queries()) - set(core_sql())))
def test_query_runs(spark, name):
    """Rows on the smallest tables that hold a case of it."""
    assert any(core_queries()[name](spark, sf).count() > 0 for sf in (SF, SF.replace("sf0.001", "sf0.01"), SF.replace("sf0.001", "sf0.1")))
