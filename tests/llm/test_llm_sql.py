import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from oracle import same  # noqa: E402

from quarry.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    same(spark, QUERIES[name], SQL[name], f"/root/testdata/{sf}")
