import pytest
from conftest import SF, same_rows

from sparkset import catalog_queries as core
from sparkset import feature_queries, shape_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(core.QUERIES[name](spark, SF), duck, core.ORACLE_SQL[name])


def test_shuffle_is_numpys(spark):
    import numpy as np

    rows = core.shuffle_seed42(spark, SF).orderBy("pos").collect()
    ids = sorted(r["doc_id"] for r in rows)
    assert [r["doc_id"] for r in rows] == [ids[i] for i in np.random.Generator(np.random.PCG64(42)).permutation(len(ids))]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = core.filter_lang(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]
    top = core.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
