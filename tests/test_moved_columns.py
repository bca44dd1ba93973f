"""What a query does not return is not moved: bodies stay out of joins that need times and titles only."""

import pytest

from newsloom.plans import queries


def joins(node):
    children = [node.children().apply(i) for i in range(node.children().size())]
    for c in children:
        yield from joins(c)
    if node.nodeName() == "Join":
        yield [c.output().mkString(",") for c in children]


@pytest.mark.parametrize("name", ["feed_home", "feed_popular_month", "popular_on_day", "popular_disjunctive_flag", "title_dice_pairs", "duplicate_pairs_keywords"])
def test_no_text_in_joins(spark, data, name):
    seen = list(joins(queries()[name](spark, data)._jdf.queryExecution().optimizedPlan()))
    assert not [s for sides in seen for s in sides if "text#" in s]
