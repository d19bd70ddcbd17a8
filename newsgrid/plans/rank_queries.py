"""Queries over clusters, their members and their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.operators import rank
from newsgrid.plans.registry import query
from newsgrid.plans.views import NOW, clusters, members, sources, table, with_views

now = lambda: F.timestamp_seconds(F.lit(NOW))
epoch = lambda c: F.unix_seconds(F.col(c)).alias(c)

KNOWN = """known AS (SELECT m.*, coalesce(s.priority, 50) AS priority, s.rights_mode AS source_rights,
  coalesce(s.type IN ('nws-alerts', 'json-api') OR s.rights_mode = 'PUBLIC_DOMAIN' OR contains(lower(s.name), 'usgs') OR contains(lower(s.name), 'city of')
  OR contains(lower(s.name), 'county of') OR contains(lower(s.name), 'national weather service'), false) AS official FROM members m LEFT JOIN sources s USING (source_id))"""
SPANS = """leads AS (SELECT cluster_id, count(*) OVER (PARTITION BY cluster_id) AS n, lead(ts, 1) OVER w - ts AS s2, lead(ts, 2) OVER w - ts AS s3 FROM members WINDOW w AS (PARTITION BY cluster_id ORDER BY ts)),
spans AS (SELECT cluster_id, min(CASE WHEN n >= 3 THEN s3 ELSE s2 END) / 60.0 AS span, min(s2) / 60.0 AS two FROM leads GROUP BY cluster_id)"""
AGG = """agg AS (SELECT cluster_id, count(DISTINCT source_id) AS p, bool_or(official) AS official, max(priority) AS priority, max(ts) AS newest, min(ts) AS first_seen, count(*) AS n FROM known GROUP BY cluster_id)"""
BREAKING = "coalesce(p >= 3 AND span <= 60, false) OR coalesce(p >= 2 AND official AND category IN ('public-safety', 'weather') AND two <= 60, false)"
SCORED = f"""parts AS (SELECT a.cluster_id, c.section, c.category, first_seen, p AS n_publishers,
  greatest(0.0, 1 - greatest(0.0, ({NOW} - newest) / 3600.0) / 72) AS freshness,
  CASE c.section WHEN 'local' THEN 1.0 WHEN 'regional' THEN 0.8 WHEN 'state' THEN 0.6 WHEN 'national' THEN 0.4 ELSE 0.2 END AS locality,
  greatest(0.0, least(1.0, (p - 1) / 2.0)) AS corroboration, greatest(0, least(100, priority)) / 100.0 AS source_priority, {BREAKING} AS breaking,
  CASE WHEN c.category IN ('public-safety', 'weather') THEN CASE WHEN c.section = 'local' THEN 1.0 ELSE 0.5 END ELSE 0.0 END AS category_boost,
  CASE WHEN ({NOW} - newest) / 3600.0 > 24 THEN least(0.3, (({NOW} - newest) / 3600.0 - 24) / 24 * 0.05) ELSE 0.0 END AS stale_penalty,
  CASE WHEN coalesce(d.n_duplicates, 0) > 0 THEN 0.1 WHEN n > 1 AND p = 1 THEN 0.05 ELSE 0.0 END AS duplicate_penalty
  FROM agg a JOIN clusters c USING (cluster_id) LEFT JOIN spans USING (cluster_id) LEFT JOIN dups d USING (cluster_id)),
scored AS (SELECT *, greatest(0.0, least(1.0, 0.25 * freshness + 0.25 * locality + 0.2 * corroboration + 0.15 * source_priority + 0.1 * breaking::INT + 0.05 * category_boost - stale_penalty - duplicate_penalty)) AS score FROM parts)"""
#: Dropped duplicates of the star tables: lines with a discount of 0.1 are copies of the order's other lines.
DUPS = "dups AS (SELECT l_orderkey AS cluster_id, count(*) AS n_duplicates FROM lineitem WHERE l_discount >= 0.1 GROUP BY l_orderkey)"


def duplicates(spark, d):
    return table(spark, d, "lineitem").filter("l_discount >= 0.1").groupBy(F.col("l_orderkey").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n_duplicates"))


def scored(spark, d):
    return rank.score_clusters(members(spark, d), sources(spark, d), clusters(spark, d), now(), duplicates(spark, d))


@query("score_clusters", with_views("members sources clusters", f"{KNOWN}, {SPANS}, {AGG}, {DUPS}, {SCORED} SELECT cluster_id, n_publishers, breaking, round(freshness, 6)::DOUBLE AS freshness, round(locality, 6)::DOUBLE AS locality, round(corroboration, 6)::DOUBLE AS corroboration, round(source_priority, 6)::DOUBLE AS source_priority, round(category_boost, 6)::DOUBLE AS category_boost, round(stale_penalty, 6)::DOUBLE AS stale_penalty, round(duplicate_penalty, 6)::DOUBLE AS duplicate_penalty, round(score, 6)::DOUBLE AS score FROM scored"))
def score_clusters(spark, d):
    parts = ("freshness", "locality", "corroboration", "source_priority", "category_boost", "stale_penalty", "duplicate_penalty", "score")
    return scored(spark, d).select("cluster_id", "n_publishers", "breaking", *[F.round(p, 6).alias(p) for p in parts])


@query("order_clusters", with_views("members sources clusters", f"{KNOWN}, {SPANS}, {AGG}, {DUPS}, {SCORED} SELECT cluster_id, first_seen, round(score, 6)::DOUBLE AS score FROM scored"))
def order_clusters(spark, d):
    return rank.order_clusters(scored(spark, d)).select("cluster_id", epoch("first_seen"), F.round("score", 6).alias("score"))


@query("attach_source", with_views("members sources", f"{KNOWN} SELECT item_id, cluster_id, priority, official, count(*) AS n FROM known GROUP BY ALL"))
def attach_source(spark, d):
    return rank.attach_source(members(spark, d), sources(spark, d)).groupBy("item_id", "cluster_id", "priority", "official").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_bounds", with_views("members", "SELECT cluster_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_members, list_sort(list(item_id)) AS member_ids FROM members GROUP BY cluster_id"))
def cluster_bounds(spark, d):
    return rank.cluster_bounds(members(spark, d)).select("cluster_id", epoch("first_seen"), epoch("last_seen"), "n_members", "member_ids")


@query("cluster_section", with_views("members", "SELECT cluster_id, ['local', 'regional', 'state', 'national', 'world'][min(list_position(['local', 'regional', 'state', 'national', 'world'], section))] AS section FROM members GROUP BY cluster_id"))
def cluster_section(spark, d):
    return rank.cluster_section(members(spark, d))


@query("cluster_category", with_views("members", "n AS (SELECT cluster_id, category, count(*) AS n, min((ts, item_id)) AS first FROM members GROUP BY ALL) SELECT cluster_id, category FROM n QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) = 1"))
def cluster_category(spark, d):
    return rank.cluster_category(members(spark, d))


@query("cluster_locations", with_views("members", "p AS (SELECT m.*, s_nationkey AS location FROM members m JOIN supplier ON source_id = s_suppkey), n AS (SELECT cluster_id, location, count(*) AS n, min((ts, item_id)) AS first FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS place FROM n) SELECT cluster_id, place, location, n FROM r WHERE place <= 3"))
def cluster_locations(spark, d):
    nations = sources(spark, d).select("source_id", F.col("nation").alias("location"))
    return rank.cluster_locations(members(spark, d).join(rank.small(nations), "source_id"))


@query("representative", with_views("members sources", f"{KNOWN} SELECT cluster_id, item_id FROM known QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY priority - CASE WHEN source_rights = 'LINK_ONLY' THEN 100 ELSE 0 END DESC, ts DESC, item_id) = 1"))
def representative(spark, d):
    return rank.representative(members(spark, d), sources(spark, d))


@query("independent_publishers", with_views("members", "SELECT cluster_id, count(DISTINCT source_id) AS n_publishers FROM members GROUP BY cluster_id"))
def independent_publishers(spark, d):
    return rank.independent_publishers(members(spark, d))


@query("confidence", with_views("members sources", f"{KNOWN}, a AS (SELECT cluster_id, count(DISTINCT source_id) AS p, count(*) AS n, bool_and(coalesce(source_rights = 'LINK_ONLY', false)) AS links, max(priority) AS priority FROM known GROUP BY cluster_id), t AS (SELECT cluster_id, CASE WHEN p >= 2 THEN 'HIGH' WHEN links THEN 'UNVERIFIED' WHEN n = 1 AND priority >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM a) SELECT cluster_id, confidence, CASE WHEN confidence = 'UNVERIFIED' THEN 'low' ELSE lower(confidence) END AS tier FROM t"))
def confidence(spark, d):
    return rank.confidence(members(spark, d), sources(spark, d))


@query("source_priority", with_views("members sources", f"{KNOWN} SELECT cluster_id, round(greatest(0, least(100, max(priority))) / 100.0, 6)::DOUBLE AS priority, bool_or(official) AS official FROM known GROUP BY cluster_id"))
def source_priority(spark, d):
    return rank.source_priority(members(spark, d), sources(spark, d)).withColumn("priority", F.round("priority", 6))


@query("duplicate_counts", with_views("members", "x AS (SELECT item_id, count(*) AS n FROM (SELECT l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS item_id FROM lineitem WHERE l_discount >= 0.1) GROUP BY item_id) SELECT cluster_id, sum(n)::BIGINT AS n_duplicates FROM members JOIN x USING (item_id) GROUP BY cluster_id"))
def duplicate_counts(spark, d):
    dropped = table(spark, d, "lineitem").filter("l_discount >= 0.1").selectExpr("l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS kept_id")
    return rank.duplicate_counts(dropped, members(spark, d))


@query("tight_spans", with_views("members", f"{SPANS} SELECT cluster_id, round(span, 6)::DOUBLE AS span, round(two, 6)::DOUBLE AS two FROM spans"))
def tight_spans(spark, d):
    return rank.tight_spans(members(spark, d)).select("cluster_id", F.round("span", 6).alias("span"), F.round("two", 6).alias("two"))


@query("breaking", with_views("members sources clusters", f"{KNOWN}, {SPANS}, {AGG} SELECT cluster_id, {BREAKING} AS breaking FROM agg JOIN clusters USING (cluster_id) LEFT JOIN spans USING (cluster_id)"))
def breaking(spark, d):
    return rank.breaking(members(spark, d), sources(spark, d), clusters(spark, d))


@query("provenance", with_views("members", "SELECT cluster_id, array_to_string(list(source_id || '@' || ts ORDER BY ts, item_id), ',') AS provenance FROM members GROUP BY cluster_id"))
def provenance(spark, d):
    """A10: the sources of a cluster in order of time."""
    ordered = F.array_sort(F.collect_list(F.struct("published_at", "item_id", "source_id")))
    return members(spark, d).groupBy("cluster_id").agg(ordered.alias("p")).select("cluster_id", F.array_join(F.transform("p", lambda x: F.concat(x["source_id"].cast("string"), F.lit("@"), F.unix_seconds(x["published_at"]).cast("string"))), ",").alias("provenance"))


@query("fingerprint", with_views("members", "SELECT cluster_id, substr(sha256(array_to_string(list(line ORDER BY line), chr(10))), 1, 32) AS fingerprint FROM (SELECT cluster_id, sha256(item_id || '|' || source_id || '|' || ts) AS line FROM members) GROUP BY cluster_id"))
def fingerprint(spark, d):
    return rank.fingerprint(members(spark, d).withColumn("ts", F.unix_seconds("published_at")), ("item_id", "source_id", "ts"))


@query("work_queue", with_views("members sources clusters", f"""{KNOWN}, {SPANS}, {AGG}, {DUPS}, {SCORED}, u AS (SELECT cluster_id, count(DISTINCT source_id) AS p, count(*) AS n, max(priority) AS priority,
  bool_or(source_rights IN ('PUBLIC_DOMAIN', 'OPEN_LICENSE', 'RSS_EXCERPT_ALLOWED', 'METADATA_ONLY')) AS usable FROM known GROUP BY cluster_id)
SELECT cluster_id, round(score, 6)::DOUBLE AS score FROM scored JOIN u USING (cluster_id) WHERE usable AND (p >= 2 OR n = 1 AND priority >= 70) AND (cluster_id % 4 < 2 OR cluster_id % 3 <> 0 OR cluster_id % 5 = 0) ORDER BY scored.score DESC, first_seen, cluster_id LIMIT 50"""))
def work_queue(spark, d):
    """A third of the briefs that unchanged clusters have still fit, but a fifth of these is incomplete."""
    m = members(spark, d)
    prints = rank.fingerprint(m, ("item_id", "source_id", "published_at"))
    k = F.col("cluster_id")
    stored = prints.select("cluster_id", F.element_at(F.array(*map(F.lit, ("new", "updated", "unchanged", "unchanged"))), (k % 4 + 1).cast("int")).alias("status"), F.lit("Headline").alias("brief_headline"), F.when(k % 5 > 0, "Body").alias("brief_body"), F.when(k % 3 == 0, F.col("fingerprint")).otherwise("old").alias("brief_fingerprint"), "fingerprint")
    return rank.work_queue(scored(spark, d), m, sources(spark, d), stored).select("cluster_id", F.round("score", 6).alias("score"))
