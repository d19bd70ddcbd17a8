"""Large tables are dealt into tasks in proportion to their rows, with the same results."""

from pyspark.sql import functions as F

from newsgrid.operators import rank
from newsgrid.plans import QUERIES, views
from tests.conftest import SMALL


def test_members_are_dealt_by_rows(spark, monkeypatch):
    whole = sorted(views.members(spark, SMALL).collect())
    monkeypatch.setattr(views, "TASK_ROWS", 400, raising=False)
    m = views.members(spark, SMALL)
    tasks = [r["count"] for r in m.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > spark.sparkContext.defaultParallelism and max(tasks) < 2 * 400
    assert sorted(m.collect()) == whole


def test_confidence_holds_no_set_of_publishers(spark):
    rows = [(1, 1, "a"), (1, 2, " A "), (2, 3, "a"), (2, 4, "b"), (3, 5, ""), (3, 6, None), (4, 7, ""), (4, 8, "b")]
    m = spark.createDataFrame(rows, "cluster_id long, item_id long, source_id string")
    s = spark.createDataFrame([("a", "x", "rss", "OPEN_LICENSE", 80)], "source_id string, name string, type string, rights_mode string, priority int")
    found = rank.confidence(m, s)
    assert {r.cluster_id: r.confidence for r in found.collect()} == {1: "LOW", 2: "HIGH", 3: "LOW", 4: "LOW"}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString() and "distinct" not in found._jdf.queryExecution().executedPlan().toString()


def test_category_makes_the_text_once(spark):
    """The text of an item is put together and folded once, not again for each keyword."""
    plan = QUERIES["classify_category"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat_ws(") == 1
