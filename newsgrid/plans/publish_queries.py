"""Queries over stories, feeds and editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.operators import publish
from newsgrid.operators.rank import small
from newsgrid.plans import views
from newsgrid.plans.registry import query
from newsgrid.plans.views import NOW, table, with_views

PLACES = ("*", "CASE country WHEN 'AMERICA' THEN 'US' ELSE country END AS land", "concat(CASE country WHEN 'AMERICA' THEN 'US' ELSE country END, '-', state) AS admin1", "concat('City ', city_no) AS city", "CASE WHEN story_id % 3 > 0 THEN concat('M', city_no % 4) END AS metro")
S = f"s AS (SELECT * EXCLUDE (country, land), land AS country FROM (SELECT {', '.join(PLACES)} FROM stories))"
FAN = r"""b AS (SELECT *, 'feeds/' || replace(lower(country), ' ', ' ') || '/' || replace(lower(state), '_', '-') || '/' AS base FROM s),
fan AS (SELECT * EXCLUDE (base), base || 'city-' || city_no || '/' AS dir, 'city' AS tier FROM b
  UNION ALL SELECT * EXCLUDE (base), base || 'regions/' || lower(metro) || '/', 'metro' FROM b WHERE country = 'US' AND metro IS NOT NULL
  UNION ALL SELECT * EXCLUDE (base), base || 'state/', 'state' FROM b WHERE country = 'US'
  UNION ALL SELECT * EXCLUDE (base), 'feeds/us/national/', 'national' FROM b WHERE country = 'US'
  UNION ALL SELECT * EXCLUDE (base), 'feeds/world/', 'world' FROM b WHERE country <> 'US')"""
ORDER = "breaking DESC, score DESC, published_s, story_id"
CAP = f"""c1 AS (SELECT *, row_number() OVER (PARTITION BY dir, section ORDER BY {ORDER}) AS n FROM fan),
c2 AS (SELECT * FROM c1 WHERE n <= CASE section WHEN 'local' THEN 20 ELSE 10 END),
capped AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY dir ORDER BY {ORDER}) AS place FROM c2) WHERE place <= 30)"""
DONORS = """heads AS (SELECT dir, tier, arg_min(country, story_id) AS country, arg_min('feeds/us/' || replace(lower(state), '_', '-') || '/', story_id) AS base, arg_min({'m': metro}, story_id).m AS metro FROM fan GROUP BY dir, tier),
named AS (SELECT dir, 1 AS step, base || 'regions/' || lower(metro) || '/' AS donor FROM heads WHERE tier = 'city' AND country = 'US' AND metro IS NOT NULL
  UNION ALL SELECT dir, 2, base || 'state/' FROM heads WHERE country = 'US' AND tier IN ('city', 'metro')
  UNION ALL SELECT dir, 3, 'feeds/us/national/' FROM heads WHERE country = 'US' AND tier IN ('city', 'metro', 'state')
  UNION ALL SELECT dir, 4, 'feeds/world/' FROM heads WHERE country <> 'US' AND tier = 'city'),
there AS (SELECT * FROM named WHERE donor IN (SELECT dir FROM heads)),
shared AS (SELECT c.dir, m.dir AS donor, count(*) AS n FROM (SELECT DISTINCT dir, story_id, admin1 FROM fan WHERE tier = 'city' AND country = 'US' AND dir NOT IN (SELECT dir FROM there WHERE step = 1)) c
  JOIN (SELECT DISTINCT dir, story_id, admin1 FROM fan WHERE tier = 'metro') m USING (story_id, admin1) GROUP BY ALL),
donors AS (SELECT dir, step, donor FROM there UNION ALL SELECT dir, 1, donor FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, donor) AS r FROM shared) WHERE r = 1)"""
FEEDS = """u AS (SELECT dir, story_id, 0 AS step, place AS pos FROM capped UNION ALL SELECT d.dir, c.story_id, d.step, c.place FROM donors d JOIN capped c ON c.dir = d.donor),
f AS (SELECT dir, story_id, min((step, pos)) AS k FROM u GROUP BY ALL),
feeds AS (SELECT dir, story_id, k[1] AS step, place FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY k) AS place FROM f) WHERE place <= 30)"""
ROWS = "rows AS (SELECT dir, unnest(CASE WHEN breaking THEN ['latest', 'morning', 'breaking'] ELSE ['latest', 'morning'] END) AS kind, story_id, section, place FROM feeds JOIN s USING (story_id))"
ALL = f"{S}, {FAN}, {CAP}, {DONORS}, {FEEDS}, {ROWS} "


def stories(spark, d):
    return views.stories(spark, d).selectExpr(*PLACES).drop("country").withColumnRenamed("land", "country")


def fanned(spark, d):
    return publish.fan_out_feeds(stories(spark, d))


def feeds(spark, d):
    return publish.build_feeds(stories(spark, d))


def editions_of(spark, d):
    return publish.edition_rows(feeds(spark, d), stories(spark, d), publish.slot_of_hour(F.lit(8)))


@query("fan_out_feeds", with_views("stories", f"{S}, {FAN} SELECT story_id, dir, tier FROM fan"))
def fan_out_feeds(spark, d):
    return fanned(spark, d).select("story_id", "dir", "tier")


@query("rank_stories", with_views("stories", f"{S}, {FAN} SELECT dir, story_id, row_number() OVER (PARTITION BY dir ORDER BY {ORDER}) AS place FROM fan WHERE tier = 'city'"))
def rank_stories(spark, d):
    """W2 over the city feeds, whose size a city bounds; wider feeds are only ever ranked under a limit (cap_stories)."""
    place = F.row_number().over(publish.Window.partitionBy("dir").orderBy(*publish.rank_order()))
    return fanned(spark, d).filter("tier = 'city'").select("dir", "story_id", place.alias("place"))


@query("cap_stories", with_views("stories", f"{S}, {FAN}, {CAP} SELECT dir, story_id, section, place FROM capped"))
def cap_stories(spark, d):
    return publish.cap_stories(fanned(spark, d)).select("dir", "story_id", "section", "place")


@query("feed_location", with_views("stories", f"{S}, {FAN} SELECT dir, arg_min(country, story_id) AS country, arg_min(admin1, story_id) AS admin1, arg_min(city, story_id) AS city, count(*) AS n_stories FROM fan GROUP BY dir, tier"))
def feed_location(spark, d):
    return publish.feed_heads(fanned(spark, d)).select("dir", "country", "admin1", "city", "n_stories")


@query("feed_donors", with_views("stories", f"{S}, {FAN}, {DONORS} SELECT * FROM donors"))
def feed_donors(spark, d):
    return publish.feed_donors(fanned(spark, d))


@query("backfill", with_views("stories", f"{S}, {FAN}, {CAP}, {DONORS}, {FEEDS} SELECT dir, story_id, step, place FROM feeds"))
def backfill(spark, d):
    return feeds(spark, d)


@query("build_feeds", with_views("stories", f"{S}, {FAN}, {CAP}, {DONORS}, {FEEDS} SELECT dir, count(*) AS n, sum(step)::BIGINT AS steps, sum(story_id * place)::BIGINT AS mark FROM feeds GROUP BY dir"))
def build_feeds(spark, d):
    return feeds(spark, d).groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps"), F.sum(F.col("story_id") * F.col("place")).alias("mark"))


@query("feed_index", with_views("stories", f"{S}, {FAN}, {CAP}, {DONORS}, {FEEDS} SELECT dir, count(*) AS n_stories, max(published_s) AS updated_s FROM feeds JOIN s USING (story_id) GROUP BY dir"))
def feed_index(spark, d):
    return publish.feed_index(feeds(spark, d), stories(spark, d))


@query("index_totals", with_views("stories", f"{S}, {FAN}, {CAP}, {DONORS}, {FEEDS} SELECT count(DISTINCT dir) AS n_feeds, count(*) AS n_stories FROM feeds"))
def index_totals(spark, d):
    """Totals over the index."""
    return publish.feed_index(feeds(spark, d), stories(spark, d)).agg(F.count(F.lit(1)).alias("n_feeds"), F.sum("n_stories").alias("n_stories"))


@query("edition_rows", with_views("stories", ALL + "SELECT dir, kind, story_id, section, place FROM rows"))
def edition_rows(spark, d):
    return editions_of(spark, d)


@query("editions", with_views("stories", ALL + "SELECT dir, kind, list(story_id ORDER BY place) AS story_ids, list_sort(list(DISTINCT section)) AS sections, count(*) AS story_count FROM rows GROUP BY dir, kind"))
def editions(spark, d):
    return publish.editions(editions_of(spark, d)).withColumn("story_count", F.col("story_count").cast("long"))


@query("attach_cluster", with_views("stories members sources clusters", f"{S}, c AS (SELECT cluster_id, section FROM clusters WHERE cluster_id % 3 > 0) SELECT story_id, coalesce(c.section, CASE WHEN metro IS NOT NULL AND story_id % 2 = 1 THEN 'regional' WHEN story_id % 2 = 0 THEN 'local' ELSE 'state' END) AS section FROM s LEFT JOIN c ON story_id = cluster_id"))
def attach_cluster(spark, d):
    known = stories(spark, d).drop("section", "score").withColumn("city", F.when(F.col("story_id") % 2 == 0, F.col("city"))).withColumn("admin2", F.lit(None).cast("string"))
    return publish.attach_cluster(known, views.clusters(spark, d).filter("cluster_id % 3 > 0").withColumn("score", F.lit(0.5))).select("story_id", "section")


@query("section_for_location", with_views("stories", f"{S} SELECT story_id, CASE WHEN story_id % 5 = 0 THEN 'local' WHEN metro IS NOT NULL AND story_id % 5 < 3 THEN 'regional' WHEN story_id % 7 > 0 THEN 'state' WHEN country = 'US' THEN 'national' ELSE 'world' END AS section FROM s"))
def section_for_location(spark, d):
    s = stories(spark, d).select("story_id", "country", F.when(F.col("story_id") % 7 > 0, F.col("admin1")).alias("admin1"), F.lit(None).cast("string").alias("admin2"), F.when(F.col("story_id") % 5 == 0, F.col("city")).alias("city"), F.when(F.col("story_id") % 5 < 3, F.col("metro")).alias("metro"))
    return s.select("story_id", publish.section_of("country", "admin1", "admin2", "city", "metro").alias("section"))


@query("slugs", "SELECT c_custkey, trim(regexp_replace(lower(c_name || ' -- ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def slugs(spark, d):
    return table(spark, d, "customer").select("c_custkey", publish.slug(F.concat("c_name", F.lit(" -- "), "c_mktsegment")).alias("slug"))


@query("story_counters", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS ai, count(*) FILTER (o_orderkey % 3 <> 0) AS cards, count(*) FILTER (o_orderstatus = 'F') AS with_image, count(*) FILTER (o_orderkey % 21 = 0) AS downgraded FROM orders")
def story_counters(spark, d):
    return publish.story_counters(table(spark, d, "orders").selectExpr("o_orderkey % 3 = 0 AS ai", "o_orderstatus = 'F' AS has_image", "o_orderkey % 21 = 0 AS downgraded"))


@query("location_slices", "WITH p AS (SELECT lower(r_name) AS country, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), g AS (SELECT country, count(*) AS n_places, min(name) AS first_name, max(name) AS last_name FROM p GROUP BY country) SELECT country, n_places, first_name, last_name FROM g UNION ALL SELECT 'us', 0, NULL, NULL WHERE 'us' NOT IN (SELECT country FROM g)")
def location_slices(spark, d):
    n = small(table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")))
    return publish.location_slices(table(spark, d, "customer").join(n, F.expr("c_nationkey = n_nationkey")).select(F.col("r_name").alias("country"), F.col("c_name").alias("name")))


@query("retain_shares", f"WITH s AS (SELECT o_orderkey AS story_id, epoch(o_orderdate)::BIGINT AS shared_s FROM orders), c AS (SELECT * FROM s WHERE story_id % 10 = 0) SELECT * FROM c UNION ALL SELECT * FROM s WHERE story_id % 4 = 0 AND shared_s >= {NOW} - 30 * 86400 AND story_id NOT IN (SELECT story_id FROM c)")
def retain_shares(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("shared_s"))
    return publish.retain_shares(s.filter("story_id % 10 = 0"), s.filter("story_id % 4 = 0"), NOW)


@query("feed_timezone", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'America/Chicago' WHEN c_nationkey % 3 = 0 THEN 'Asia/Tokyo' WHEN c_nationkey % 5 = 0 THEN 'Europe/Berlin' WHEN c_mktsegment = 'MACHINERY' THEN 'America/New_York' ELSE 'UTC' END AS zone FROM customer")
def feed_timezone(spark, d):
    nations = table(spark, d, "nation")
    zone = lambda m, z: nations.filter(F.col("n_nationkey") % m == 0).select(F.upper("n_name").alias("key"), F.lit(z).alias("zone"))
    feeds_ = table(spark, d, "customer").join(small(nations), F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.col("n_name").alias("city"), F.col("n_name").alias("metro"), F.col("n_name").alias("admin1"), F.when(F.col("c_mktsegment") == "MACHINERY", "us").otherwise("FR").alias("country"))
    return publish.feed_timezone(feeds_, zone(2, "America/Chicago"), zone(3, "Asia/Tokyo"), zone(5, "Europe/Berlin")).select("c_custkey", "zone")


@query("edition_slots", "SELECT event_id, CASE WHEN hour(ts - INTERVAL 9 HOUR + INTERVAL 18 HOUR) BETWEEN 3 AND 9 THEN 'morning' WHEN hour(ts - INTERVAL 9 HOUR + INTERVAL 18 HOUR) BETWEEN 10 AND 15 THEN 'afternoon' WHEN hour(ts - INTERVAL 9 HOUR + INTERVAL 18 HOUR) BETWEEN 16 AND 21 THEN 'evening' END AS slot FROM events")
def edition_slots(spark, d):
    """R16 in Tokyo, nine hours ahead of UTC all year."""
    return table(spark, d, "events").select("event_id", publish.edition_slot(F.col("ts").cast("timestamp"), F.lit("Asia/Tokyo")).alias("slot"))
