import pytest
from oracle import same

from quarry.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
#: On the smallest tables, a tenth of the baskets is so few that every set is frequent, beyond the SQL's seven items, and
#: the sample proves nothing.
LARGER = dict.fromkeys(["son_chunks", "itemsets_toivonen", "toivonen_attempts"], "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], SQL[name], LARGER.get(name, SMALL))


@pytest.mark.parametrize("name", ["cure_assign", "mf_sgd_errors", "svd_singular_values", "bdmo_clusters", "kmeans_choose_k", "bfr_clusters", "cure_clusters", "grgpf_clusters"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_learning_is_not_cut_short(spark):
    assert QUERIES["mf_sgd_errors"](spark, SMALL).count() == 40
    assert QUERIES["svm_stochastic_costs"](spark, SMALL).count() > 11


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
