"""Joins of the brief checks that must not gather what grows with the briefs."""

from newsgrid.operators import briefs
from pyspark.sql import functions as F


def test_runs_of_briefs_are_not_broadcast(spark):
    """The closed texts go to the tasks, not the runs of all briefs, whatever Spark takes these for."""
    fields = spark.createDataFrame([(k, "a b c d e f g h i j k l m") for k in range(3)], "event_id long, text string")
    closed = spark.createDataFrame([(k, f"x{k} b c d e f g h i j k l m") for k in range(60)], "source_id long, text string")
    found = briefs.check_verbatim(fields, closed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert found.count() == 180


def test_tables_of_briefs_are_not_broadcast(spark):
    own = spark.createDataFrame([(1, ["x"]), (2, [])], "event_id long, source_ids array<string>")
    members = spark.createDataFrame([(1, "X", "s", "u"), (2, "y", "t", "")], "event_id long, item_id string, source_id string, url string")
    found = briefs.check_source_ids(own, members)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(2, "no source ids"), (2, "source without URL: y")]


def test_background_grows_with_the_words(spark):
    """the words of the sources are put into a set once, not once for each sentence, and texts are not broadcast."""
    from newsgrid.plans.brief_queries import evidence
    from tests.conftest import SMALL

    few, many = "Alpha beta gamma delta epsilon. ", "Alphas betaed zeta eta theta. "
    rows = [(1, few * 3000, "alpha betas gammas Deltas", "", []), (2, few + many, "alpha betas gammas", "", ["Delta town"]), (3, few, "alpha beta gamma", "May 3", []), (4, few, None, "", None), (5, "U.S. Alpha beta. Of the sources.", "", "", [])]
    rows.append((6, few + " ".join(f"w{k}x" for k in range(20000)), " ".join(f"w{k}x" for k in range(20000)) + " alpha beta gamma", None, []))
    briefs_ = spark.createDataFrame(rows, "event_id int, body string, source_text string, dated_text string, places array<string>").withColumn("dek", F.lit(None).cast("string"))
    found = briefs_.select("event_id", F.array_contains(briefs.check_background(), "background: sentence under 60 % covered").alias("thin"))
    assert {r[0]: r[1] for r in found.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True}
    assert "array_except" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in evidence(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
