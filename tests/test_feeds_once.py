"""Feeds are made once, whatever reads them."""

from newsgrid.operators import publish
from newsgrid.plans import publish_queries as pq
from tests.conftest import SMALL


def test_directories_are_made_once(spark):
    """What is read of feeds is a table of them, so stories are not fanned out once for each use."""
    feeds = publish.build_feeds(pq.stories(spark, SMALL))
    assert feeds.count() > 0
    plan = feeds._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "Window" not in plan
    index = publish.feed_index(feeds, pq.stories(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in index
