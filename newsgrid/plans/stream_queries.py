"""Streaming jobs run over the events table, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.operators.library import in_quiet_hours
from newsgrid.plans.registry import query
from newsgrid.plans.views import table
from newsgrid.streaming import jobs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, d):
    """The events as a stream of news members: clusters are readers, sources are values."""
    single = spark.read.parquet(f"{d}/events.parquet").inputFiles()[0].endswith("/events.parquet")
    reader = spark.readStream.schema(EVENTS)
    # a streaming source is a folder: the table's own, or the one its file lies in
    s = reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(f"{d}/events.parquet")
    return s.select("event_id", F.col("ts").cast("timestamp").alias("published_at"), "user_id", "event_type", F.col("user_id").alias("cluster_id"), (F.col("event_id") % 17).alias("source_id"), "value")


BOUND = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("stream_health", f"SELECT event_type AS source_id, epoch(date_trunc('day', ts))::BIGINT AS day, count(*) AS n, epoch_us(max(ts)) AS newest FROM events GROUP BY ALL HAVING date_trunc('day', max(ts)) + INTERVAL 1 DAY <= {BOUND}")
def stream_health(spark, d):
    out = jobs.run_to_table(jobs.stream_health(events(spark, d).drop("source_id").withColumnRenamed("event_type", "source_id")))
    return out.select("source_id", F.unix_seconds("day").alias("day"), "n", F.unix_micros("newest").alias("newest"))


@query("stream_dedup", "SELECT event_type, count(DISTINCT value) AS n FROM events GROUP BY event_type")
def stream_dedup(spark, d):
    s = events(spark, d).withColumn("url", F.concat_ws("/", "event_type", F.col("value").cast("string")))
    return jobs.run_to_table(jobs.stream_dedup(s, "url", "60 days")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_guard", "SELECT count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 01:00:00'")
def stream_guard(spark, d):
    out = jobs.run_to_table(jobs.stream_guard(events(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp")))
    return out.agg(F.count(F.lit(1)).alias("n"))


@query("stream_breaking", f"WITH w AS (SELECT user_id AS cluster_id, event_id % 17 AS s, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * unnest(range(0, 8)) AS start FROM events) SELECT cluster_id, epoch(start)::BIGINT AS start, count(DISTINCT s) AS n_publishers FROM w WHERE start + INTERVAL 4 HOUR <= {BOUND} GROUP BY ALL HAVING count(DISTINCT s) >= 2")
def stream_breaking(spark, d):
    out = jobs.run_to_table(jobs.stream_breaking(events(spark, d), 2, "4 hours", "30 minutes"))
    return out.select("cluster_id", F.unix_seconds("start").alias("start"), "n_publishers")


@query("stream_sessions", f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS cluster_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {BOUND}")
def stream_sessions(spark, d):
    out = jobs.run_to_table(jobs.stream_sessions(events(spark, d), "6 hours"))
    return out.select("cluster_id", F.unix_micros("start").alias("start"), "n")


@query("stream_source_sets", "SELECT DISTINCT user_id AS cluster_id, (event_id % 17)::VARCHAR AS source_id FROM events")
def stream_source_sets(spark, d):
    return jobs.with_rocksdb(lambda: jobs.stream_source_sets(events(spark, d)), spark)


@query("stream_alerts", "SELECT event_id % 1000 AS alert_id, count(DISTINCT 1) AS n FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1")
def stream_alerts(spark, d):
    a = events(spark, d).filter("event_type = 'error'").selectExpr("event_id % 1000 AS alert_id", "'x' AS event", "CASE WHEN value > 100 THEN 'Severe' END AS severity", "published_at AS effective")
    return jobs.run_to_table(jobs.stream_alerts(a)).groupBy("alert_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_quota", "SELECT user_id, event_id AS story_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE NOT (hour(ts) >= 22 OR hour(ts) < 7) QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3")
def stream_quota(spark, d):
    def awake():
        s = events(spark, d).filter(~in_quiet_hours(F.hour("published_at"), F.lit(22), F.lit(7)))
        return jobs.stream_quota(s.selectExpr("user_id", "event_id AS story_id", "published_at AS at"))

    return jobs.with_rocksdb(awake, spark)


#: Three batches of clusters of customers (k): each has two items at first; then some come again under another id with a new
#: source (0), some as they were (1), some as one cluster with a neighbour's items (2), some not at all (3), some grow twice (4).
BATCHES = """SELECT 0 AS batch, 'a' || c_custkey AS event_id, c_custkey * 10 + i AS item_id, 's1' AS source_id, CASE WHEN c_custkey % 6 = 5 THEN 0 ELSE 500000 END AS at FROM customer, (SELECT 1 AS i UNION ALL SELECT 2)
UNION ALL SELECT 1, 'b' || c_custkey, c_custkey * 10 + i, 's' || i, 500100 FROM customer, (SELECT 1 AS i UNION ALL SELECT 3) WHERE c_custkey % 6 = 0 OR c_custkey % 6 = 4
UNION ALL SELECT 1, 'a' || c_custkey, c_custkey * 10 + i, 's1', 500000 FROM customer, (SELECT 1 AS i UNION ALL SELECT 2) WHERE c_custkey % 6 = 1
UNION ALL SELECT 1, 'c' || (c_custkey - c_custkey % 12), c_custkey * 10 + i, 's1', 500200 FROM customer, (SELECT 1 AS i UNION ALL SELECT 2) WHERE c_custkey % 6 = 2
UNION ALL SELECT 2, 'd' || c_custkey, c_custkey * 10 + i, 's' || i, 500300 FROM customer, (SELECT 3 AS i UNION ALL SELECT 4) WHERE c_custkey % 6 = 4"""


@query("stream_state", """WITH c AS (SELECT c_custkey AS k, c_custkey % 6 AS kind, c_custkey - c_custkey % 12 AS pair FROM customer), twos AS (SELECT pair, min('a' || k) AS low, max('a' || k) AS high, count(*) AS n FROM c WHERE kind = 2 GROUP BY pair)
SELECT 'a' || k AS event_id, CASE kind WHEN 4 THEN 'updated' ELSE 'unchanged' END AS status, CASE kind WHEN 0 THEN 2 WHEN 4 THEN 3 ELSE 1 END AS version, CASE kind WHEN 0 THEN 'b' || k WHEN 4 THEN 'b' || k || ',d' || k ELSE '' END AS aliases, CASE kind WHEN 0 THEN 500100 WHEN 4 THEN 500300 ELSE 500000 END::BIGINT AS last_seen_s, 2 AS n_items FROM c WHERE kind NOT IN (2, 5)
UNION ALL SELECT low, 'unchanged', 1, CASE WHEN n = 2 THEN high || ',c' || pair ELSE 'c' || pair END, 500200, 2 * n FROM twos""")
def stream_state(spark, d):
    """ST6 over three batches: clusters that grow, stay, merge, are carried along and grow old."""
    table(spark, d, "customer").createOrReplaceTempView("_customers")
    rows = spark.sql(BATCHES.replace("customer", "_customers").replace("c_custkey", "CAST(c_custkey AS bigint)"))
    rows = rows.select("batch", "event_id", F.col("at").cast("long").alias("first_seen_s"), F.col("at").cast("long").alias("last_seen_s"), F.array().cast("array<string>").alias("aliases"), "item_id", "source_id")
    # what was last seen at 0 grows too old between the first batch and the second
    held = jobs.stream_state(jobs.land(rows, "batch").drop("batch"), jobs._place(spark), lambda n: 500000 + n * 200000, 7)
    sizes = held.members(2).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_items"))
    return held.clusters(2).join(sizes, "event_id").select("event_id", "status", "version", F.array_join("aliases", ",").alias("aliases"), "last_seen_s", "n_items")


@query("stream_tight_spans", "WITH o AS (SELECT user_id, ts, lead(ts) OVER w AS b, lead(ts, 2) OVER w AS c, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id AS cluster_id, round(min(CASE WHEN n = 2 THEN epoch_us(b) ELSE epoch_us(c) END - epoch_us(ts)) / 6e7, 6)::DOUBLE AS span, round(min(epoch_us(b) - epoch_us(ts)) / 6e7, 6)::DOUBLE AS two FROM o GROUP BY user_id")
def stream_tight_spans(spark, d):
    """ST4 in batches of a day each: the exact spans of all reports."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("published_at"), F.col("user_id").alias("cluster_id"))
    week = rows.withColumn("week", F.floor(F.unix_seconds("published_at") / 604800))
    out = jobs.with_rocksdb(lambda: jobs.stream_tight_spans(jobs.land(week, "week"), 3), spark)
    last = out.groupBy("cluster_id").agg(F.max_by(F.struct("span", "two"), "n").alias("x"))
    return last.select("cluster_id", F.round("x.span", 6).alias("span"), F.round("x.two", 6).alias("two"))


@query("stream_ingest", "SELECT event_id::VARCHAR AS source_id, 'M ' || value AS title FROM events")
def stream_ingest(spark, d):
    """ST1 over landed quake documents made from the events."""
    place = jobs._place(spark)
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("M "), F.col("value").cast("string")).alias("title"), F.lit(0).alias("time"), F.lit("https://q/").alias("url")).alias("properties"))).alias("features")))
    landed = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("source_id"), F.lit("json-api").alias("type"), F.lit("https://f").alias("feed_url"), body.alias("body"))
    landed.write.json(f"{place}/landing")
    jobs.stream_ingest(spark, f"{place}/landing", f"{place}/items")
    return spark.read.parquet(f"{place}/items").select("source_id", "title")
