"""Queries of story rows, evidence packs and feed documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsgrid.operators import library, rank, stories, weather
from newsgrid.plans import views
from newsgrid.plans.rank_queries import AGG, DUPS, KNOWN, SCORED, SPANS, scored
from newsgrid.plans.registry import query
from newsgrid.plans.views import table, with_views
from newsgrid.sources import feeds

M = """m AS (SELECT cluster_id, item_id, source_id, ts, CASE WHEN item_id % 7 > 0 THEN 'P' || source_id END AS publisher, CASE WHEN item_id % 3 = 0 THEN 'Text ' || item_id END AS excerpt, s.rights_mode FROM members LEFT JOIN sources s USING (source_id))"""
C = "c AS (SELECT cluster_id, category, CASE WHEN cluster_id % 4 = 0 THEN 'Fire' WHEN cluster_id % 4 = 1 THEN '' ELSE 'Fire in town ' || cluster_id END AS headline, CASE cluster_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'UNVERIFIED' WHEN 2 THEN 'medium' END AS tier, cluster_id % 9 AS version FROM clusters)"


def members(spark, d):
    m = views.members(spark, d).join(rank.small(views.sources(spark, d).select("source_id", "rights_mode")), "source_id", "left")
    return m.select("cluster_id", "item_id", "source_id", "published_at", F.when(F.col("item_id") % 7 > 0, F.concat(F.lit("P"), "source_id")).alias("publisher"), F.concat(F.lit("H"), "item_id").alias("headline"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Text "), "item_id")).alias("excerpt"), F.concat(F.lit("https://u/"), "item_id").alias("url"), "rights_mode")


def clusters(spark, d):
    k = F.col("cluster_id") % 4
    place = F.array(F.struct(F.lit("US").alias("country")))
    return views.clusters(spark, d).select("cluster_id", "category", F.when(k == 0, "Fire").when(k == 1, "").otherwise(F.concat(F.lit("Fire in town "), "cluster_id")).alias("headline"), F.when(k == 0, "HIGH").when(k == 1, "UNVERIFIED").when(k == 2, "medium").alias("tier"), (F.col("cluster_id") % 9).alias("version"), F.lit(False).alias("breaking"), F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("timestamp").alias("last_seen"), place.alias("locations"), F.array(F.lit("Troy")).alias("places"))


TIER = "CASE WHEN lower(tier) IN ('high', 'medium') THEN lower(tier) ELSE 'low' END AS tier"


@query("card_stories", with_views("members sources clusters", f"{M}, {C}, x AS (SELECT cluster_id, arg_max(excerpt, (ts, item_id)) AS excerpt FROM m WHERE excerpt IS NOT NULL GROUP BY cluster_id), n AS (SELECT cluster_id, count(*) AS n FROM m WHERE publisher IS NOT NULL GROUP BY cluster_id) SELECT cluster_id AS story_id, CASE WHEN headline = '' THEN 'Developing story' WHEN length(headline) < 8 THEN headline || ' — developing story' ELSE headline END AS headline, excerpt, {TIER}, coalesce(n, 0) AS n_sources FROM c LEFT JOIN x USING (cluster_id) LEFT JOIN n USING (cluster_id)"))
def card_stories(spark, d):
    return stories.card_stories(clusters(spark, d), members(spark, d)).select("story_id", "headline", "excerpt", "tier", F.greatest(F.lit(0), F.coalesce(F.size("sources"), F.lit(0))).cast("long").alias("n_sources"))


@query("brief_stories", with_views("members sources clusters", f"{M}, {C} SELECT cluster_id AS story_id, 'Brief ' || cluster_id AS headline, 6000 AS body_chars, CASE WHEN cluster_id % 2 = 0 THEN 'sports' ELSE category END AS category, {TIER}, CASE WHEN cluster_id % 6 = 0 THEN 2 ELSE 1 END AS n_locations FROM c WHERE cluster_id % 3 = 0"))
def brief_stories(spark, d):
    land = lambda c: F.struct(F.lit(c).alias("country"))
    b = views.clusters(spark, d).filter("cluster_id % 3 = 0").select(F.col("cluster_id").alias("event_id"), F.concat(F.lit("Brief "), "cluster_id").alias("headline"), F.lit("").alias("dek"), F.lit("x" * 7000).alias("body"), F.when(F.col("cluster_id") % 2 == 0, "sports").otherwise("").alias("category"), F.when(F.col("cluster_id") % 2 == 0, F.array(land("US"), land("FR"))).otherwise(F.array().cast("array<struct<country:string>>")).alias("locations"))
    out = stories.brief_stories(b, clusters(spark, d), members(spark, d))
    return out.select("story_id", "headline", F.length("body").alias("body_chars"), "category", "tier", F.size("locations").alias("n_locations"))


@query("evidence_pack", with_views("members sources clusters", f"{M} SELECT cluster_id, count(*) AS n, count(*) FILTER (excerpt IS NOT NULL AND rights_mode IN ('PUBLIC_DOMAIN', 'OPEN_LICENSE', 'RSS_EXCERPT_ALLOWED')) AS with_text FROM m GROUP BY cluster_id"))
def evidence_pack(spark, d):
    pack = stories.evidence_pack(clusters(spark, d), members(spark, d))
    found = F.from_json("pack", "sources array<struct<id:bigint,excerpt:string>>, places array<string>")
    return pack.withColumn("p", found).select("cluster_id", F.size("p.sources").cast("long").alias("n"), F.size(F.filter("p.sources", lambda s: s["excerpt"].isNotNull())).cast("long").alias("with_text"))


@query("queue_manifest", with_views("members sources clusters", f"{KNOWN}, {SPANS}, {AGG}, {DUPS}, {SCORED}, q AS (SELECT cluster_id, row_number() OVER (ORDER BY score DESC, first_seen, cluster_id) AS place FROM scored) SELECT list(cluster_id ORDER BY place) AS queued, count(*) AS n FROM q WHERE place <= 50"))
def queue_manifest(spark, d):
    queue = rank.order_clusters(scored(spark, d)).limit(50)  # the limit is the feature
    place = F.row_number().over(Window.orderBy(F.desc("score"), "first_seen", "cluster_id"))
    return stories.queue_manifest(queue.withColumn("place", place))


@query("parse_rss", "SELECT c_custkey AS source_id, c_name || ' & Co' AS title, 'https://x/' || c_custkey AS url, '<b>' || c_mktsegment || '</b>' AS summary_html, 1704189600 AS at FROM customer")
def parse_rss(spark, d):
    item = F.concat(F.lit("<rss><channel><title>t</title><item><title>"), "c_name", F.lit(" &amp; Co</title><link>https://x/"), F.col("c_custkey").cast("string"), F.lit("</link><description><![CDATA[<b>"), "c_mktsegment", F.lit("</b>]]></description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item><item><title></title><link>l</link></item></channel></rss>"))
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), item.alias("body"))
    return feeds.parse_rss(raw).select("source_id", "title", "url", "summary_html", F.unix_seconds("published_at").cast("int").alias("at"))


@query("parse_atom", "SELECT c_custkey AS source_id, c_name AS title, 'https://x/' || c_custkey AS url, c_mktsegment AS summary_html FROM customer")
def parse_atom(spark, d):
    entry = F.concat(F.lit("<feed><entry><title>"), "c_name", F.lit("</title><link rel=\"self\" href=\"https://y\"/><link rel=\"alternate\" href=\"https://x/"), F.col("c_custkey").cast("string"), F.lit("\"/><content>"), "c_mktsegment", F.lit("</content><updated>2024-01-02T10:00:00Z</updated></entry></feed>"))
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), entry.alias("body"))
    return feeds.parse_atom(raw).select("source_id", "title", "url", "summary_html")


@query("ingest", "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'rss' ELSE 'atom' END AS kind, count(*) AS n FROM customer WHERE c_custkey % 4 < 2 GROUP BY ALL")
def ingest(spark, d):
    """IO10: documents of two types, some hostile and some broken."""
    body = F.expr("""CASE c_custkey % 4 WHEN 0 THEN concat('<rss><channel><title>t</title><item><title>', c_name, '</title><link>l</link></item></channel></rss>')
      WHEN 1 THEN concat('<feed><entry><title>', c_name, '</title><link href="l"/></entry></feed>') WHEN 2 THEN '<!DOCTYPE x [<!ENTITY a "b">]><rss/>' ELSE '<rss><channel><item>' END""")
    kind = F.expr("CASE c_custkey % 4 WHEN 1 THEN 'atom' ELSE 'rss' END")
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), kind.alias("type"), F.lit("https://f").alias("feed_url"), body.alias("body"))
    return feeds.ingest(raw).join(raw.select("source_id", F.col("type").alias("kind")), "source_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("decode_body", "SELECT doc_id, text FROM documents")
def decode_body(spark, d):
    """IO6: texts as UTF-8, or as a one-byte code page where they fit into it."""
    text = F.regexp_replace("text", "[^\\x00-\\xFF]", "")
    same = table(spark, d, "documents").filter(F.col("text") == text)
    latin = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    odd = table(spark, d, "documents").filter(F.col("text") != text).select("doc_id", "text")
    return same.select("doc_id", feeds.decode_body(latin, F.lit("latin-1")).alias("text")).union(odd)


@query("parse_images", "SELECT p_partkey AS story_id, p_name AS title FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 5 > 0")
def parse_images(spark, d):
    """N19."""
    body = F.expr("""concat('{"query": {"pages": {"7": {"title": "File:', p_name, '.jpg", "imageinfo": [{"url": "', CASE WHEN p_partkey % 5 > 0 THEN 'https://upload.' ELSE 'http://x' END, '/1", "descriptionurl": "u", "extmetadata": {"LicenseShortName": {"value": "', CASE WHEN p_partkey % 3 > 0 THEN 'CC BY-SA 3.0' ELSE 'CC BY-NC 3.0' END, '"}}}]}}}}')""")
    return library.parse_image_candidates(table(spark, d, "part").select(F.col("p_partkey").alias("story_id"), body.alias("body"))).select("story_id", "title")


@query("weather_points", "SELECT event_id AS bucket, value AS temp_c, 'sym' || event_id % 3 AS symbol, CASE WHEN event_id % 2 = 0 THEN 10.0 ELSE 60.0 END::DOUBLE AS precip FROM events")
def weather_points(spark, d):
    """Forecast JSON of one point each, whose next hour or only the next six are known."""
    near = F.expr("""CASE WHEN event_id % 2 = 0 THEN concat('"next_1_hours": {"summary": {"symbol_code": "sym', event_id % 3, '"}, "details": {"probability_of_precipitation": 10.0}}, ') ELSE '' END""")
    body = F.concat(F.lit('{"properties": {"timeseries": [{"time": "2024-01-01T00:00:00Z", "data": {"instant": {"details": {"air_temperature": '), F.col("value").cast("string"), F.lit("}}, "), near, F.lit('"next_6_hours": {"summary": {"symbol_code": "sym'), (F.col("event_id") % 3).cast("string"), F.lit('"}, "details": {"probability_of_precipitation": 60.0}}}}]}}'))
    return weather.hourly_points(table(spark, d, "events").select(F.col("event_id").alias("bucket"), body.alias("body"))).select("bucket", "temp_c", "symbol", "precip")
