"""Every query of the library that has SQL gives the rows of its SQL."""

import pytest

from newsloom import plans
from oracle import connection, rows


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, data, name):
    found = plans.queries()[name](spark, data).toPandas()
    wanted = connection(data).execute(plans.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(plans.queries().keys() - plans.oracle_sql().keys()))
def test_runs(spark, data, name):
    assert plans.queries()[name](spark, data).count() >= 0


def test_no_cross_products(spark, data):
    for name in ("feed_latest", "feed_popular_exists", "duplicate_pairs_keywords", "title_dice_pairs", "article_upsert", "issue_counts"):
        plan = plans.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
