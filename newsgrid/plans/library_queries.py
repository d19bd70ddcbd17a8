"""Queries of the reader's library, weather and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.functions import weather as wx
from newsgrid.operators import library as lib
from newsgrid.operators import normalize, publish, weather
from newsgrid.plans import publish_queries as pq
from newsgrid.plans.registry import query
from newsgrid.plans.sink_queries import folder
from newsgrid.plans.views import NOW, items, sources, table, with_views
from newsgrid.sources import feeds


def story_rows(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id AS story_id", "text", "lang AS category", "doc_id * 1000 % 7919 AS published_s")


@query("search_index", "SELECT term, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM documents) GROUP BY term")
def search_index(spark, d):
    return lib.search_index(story_rows(spark, d), "text").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("search", """WITH w AS (SELECT doc_id AS story_id, doc_id * 1000 % 7919 AS published_s, lang, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents)
SELECT story_id, published_s FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'thin'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'an'))) > 0 AND lang = 'en' AND story_id % 3 = 0 ORDER BY published_s DESC, story_id LIMIT 100""")
def search(spark, d):
    s = story_rows(spark, d)
    links = s.selectExpr("story_id", "concat('L', story_id % 3) AS location_id")
    return lib.search(lib.search_index(s, "text"), s, "Thin* an", "en", links, "L0").select("story_id", "published_s")


@query("search_written", """WITH w AS (SELECT doc_id AS story_id, doc_id * 1000 % 7919 AS published_s, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents)
SELECT story_id, published_s FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'th'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'une'))) > 0 ORDER BY published_s DESC, story_id LIMIT 100""")
def search_written(spark, d):
    """J16 over posting lists in ranges of terms."""
    s, at = story_rows(spark, d), folder(spark, "search")
    lib.write_search_index(lib.search_index(s, "text"), at)
    return lib.search_written(at, s, "th une").select("story_id", "published_s")


@query("saved_stories", "SELECT o_orderkey AS story_id, o_custkey AS saved_s, o_totalprice FROM orders WHERE o_orderkey % 5 = 0 ORDER BY saved_s DESC, story_id")
def saved_stories(spark, d):
    o = table(spark, d, "orders")
    return lib.saved_stories(o.filter("o_orderkey % 5 = 0").selectExpr("o_orderkey AS story_id", "o_custkey AS saved_s"), o.selectExpr("o_orderkey AS story_id", "o_totalprice")).select("story_id", "saved_s", "o_totalprice")


@query("expire", f"SELECT o_orderkey AS story_id FROM orders WHERE epoch(o_orderdate)::BIGINT >= {NOW} - 100 * 86400 OR o_orderkey % 10 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def expire(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("story_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("published_s"))
    return lib.expire(s, s.filter("story_id % 10 = 0"), table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("story_id")), NOW - 100 * 86400).select("story_id")


@query("orphans", "SELECT l_orderkey AS story_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def orphans(spark, d):
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("story_id"))
    return lib.orphans(children, table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("story_id"))).groupBy("story_id").agg(F.count(F.lit(1)).alias("n"))


@query("retention", f"SELECT k AS kind, count(*) AS n FROM (VALUES ('editions', 3), ('stories', 7), ('alerts', 30)) t(k, days), orders WHERE epoch(o_orderdate)::BIGINT >= {NOW} - 50 * days * 86400 + 49 * days * 86400 GROUP BY k")
def retention(spark, d):
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    o = table(spark, d, "orders")
    kept = lib.retention(o.select(at.alias("fetched_s")), o.select(at.alias("published_s")), o.select(at.alias("notified_s")), NOW)
    parts = [t.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(k).alias("kind"), "n") for k, t in kept.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("lookup_translation", "SELECT c_custkey AS story_id, CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 2 = 1 THEN c_name END AS translation, c_custkey % 3 = 0 AND c_nationkey % 2 = 0 AS stale FROM customer")
def lookup_translation(spark, d):
    c = table(spark, d, "customer")
    cache = c.filter("c_custkey % 3 = 0").selectExpr("c_custkey AS story_id", "c_nationkey % 2 AS version", "'fr' AS lang", "c_name AS text").union(c.selectExpr("c_custkey", "1", "'de'", "'x'"))
    return lib.lookup_translation(c.selectExpr("c_custkey AS story_id", "1 AS version"), cache, "fr").select("story_id", "translation", "stale")


@query("rerank_interests", with_views("stories", f"{pq.S}, {pq.FAN}, {pq.CAP} SELECT dir, story_id, category IN ('weather', 'sports') AS chosen FROM capped ORDER BY dir, chosen DESC, place"))
def rerank_interests(spark, d):
    return lib.rerank_interests(publish.cap_stories(pq.fanned(spark, d)), ["weather", "sports"]).select("dir", "story_id", "chosen")


@query("pick_places", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 AND (contains(c_name, '1') OR c_custkey % 2 = 0) ORDER BY c_name")
def pick_places(spark, d):
    p = table(spark, d, "customer").selectExpr("c_custkey", "c_name", "c_name AS name", "c_mktsegment AS type", "cast(c_nationkey AS string) AS parent", "array(CASE WHEN c_custkey % 2 = 0 THEN 'One1' ELSE 'none' END) AS aliases")
    return lib.pick_places(p, "BUILDING", "3", "1").select("c_custkey", "c_name")


@query("set_home", "SELECT c_custkey AS place_id, c_custkey = 7 AS is_home FROM customer ORDER BY c_nationkey, c_name")
def set_home(spark, d):
    p = table(spark, d, "customer").selectExpr("c_custkey AS place_id", "true AS is_home", "c_nationkey AS sort_order", "c_name AS label")
    return lib.saved_places(lib.set_home(p, 7)).select("place_id", "is_home")


@query("upsert_replace", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 = 0 UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_orderkey % 4 = 0")
def upsert_replace(spark, d):
    o = table(spark, d, "orders")
    fresh = o.filter("o_orderkey % 4 = 0").selectExpr("o_orderkey", "'new' AS v", "2 AS at").union(o.filter("o_orderkey % 4 = 0").selectExpr("o_orderkey", "'older'", "1")).union(o.filter("o_orderkey % 4 = 0").selectExpr("-o_orderkey - 1", "'new'", "1"))
    return lib.upsert(o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey", "o_orderstatus AS v", "0 AS at"), fresh, ["o_orderkey"], order="at").select("o_orderkey", "v")


@query("upsert_without_order", "SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 > 0)")
def upsert_without_order(spark, d):
    base = table(spark, d, "customer").selectExpr("c_custkey AS o_custkey", "cast(-1 AS bigint) AS v")
    return lib.upsert(base, table(spark, d, "orders").filter("o_custkey % 3 > 0").selectExpr("o_custkey", "o_orderkey AS v"), ["o_custkey"])


@query("upsert_ignore", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'new' END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert_ignore(spark, d):
    o = table(spark, d, "orders")
    return lib.upsert(o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey", "o_orderstatus AS v"), o.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey", "'new' AS v"), ["o_orderkey"], "ignore")


@query("replace_edition", "SELECT l_orderkey % 50 AS edition_id, l_partkey AS story_id, count(*) AS n FROM lineitem WHERE l_orderkey % 50 >= 10 GROUP BY ALL UNION ALL SELECT l_orderkey % 50, -l_partkey, count(*) FROM lineitem WHERE l_orderkey % 50 < 10 GROUP BY ALL")
def replace_edition(spark, d):
    links = table(spark, d, "lineitem").selectExpr("l_orderkey % 50 AS edition_id", "l_partkey AS story_id")
    return lib.replace_edition(links, links.filter("edition_id < 10").selectExpr("edition_id", "-story_id AS story_id")).groupBy("edition_id", "story_id").agg(F.count(F.lit(1)).alias("n"))


@query("edition_changes", "SELECT user_id AS location_id, event_id, edition_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, event_type AS edition_id FROM events) WHERE b IS NOT NULL AND b <> edition_id")
def edition_changes(spark, d):
    log = table(spark, d, "events").selectExpr("user_id AS location_id", "event_id AS at_s", "event_id", "event_type AS edition_id")
    return lib.edition_changes(log).select("location_id", "event_id", "edition_id")


@query("breaking_picks", with_views("stories", f"""{pq.S}, {pq.FAN}, {pq.CAP}, u AS (SELECT c_custkey AS user_id, 'feeds/us/national/' AS dir, c_custkey % 4 AS sent, c_custkey % 24 AS hour, CASE WHEN c_nationkey % 3 = 0 THEN ['weather'] ELSE [] END AS interests FROM customer),
f AS (SELECT user_id, story_id, sent, row_number() OVER (PARTITION BY user_id ORDER BY place, story_id) AS turn FROM u JOIN capped USING (dir) WHERE breaking AND (len(interests) = 0 OR list_contains(interests, category)) AND NOT (hour >= 22 OR hour < 7) AND (user_id + story_id) % 5 > 0)
SELECT user_id, story_id, turn FROM f WHERE turn <= 3 - sent"""))
def breaking_picks(spark, d):
    capped = publish.cap_stories(pq.fanned(spark, d)).filter("dir = 'feeds/us/national/'")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("feeds/us/national/").alias("dir"), (F.col("c_custkey") % 4).alias("sent"), (F.col("c_custkey") % 24).alias("hour"), F.lit(22).alias("quiet_start"), F.lit(7).alias("quiet_end"), F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("weather"))).otherwise(F.array().cast("array<string>")).alias("interests"))
    known = users.select("user_id", "dir").join(capped.select("dir", "story_id"), "dir").filter((F.col("user_id") + F.col("story_id")) % 5 == 0).select("user_id", "story_id")
    return lib.breaking_picks(capped, users, known)


@query("quiet_hours", "SELECT o_orderkey, CASE WHEN s = e THEN false WHEN s < e THEN h >= s AND h < e ELSE h >= s OR h < e END AS quiet FROM (SELECT o_orderkey, o_orderkey % 24 AS h, o_custkey % 24 AS s, o_custkey % 13 AS e FROM orders)")
def quiet_hours(spark, d):
    c = lambda n, m: F.col(n) % m
    return table(spark, d, "orders").select("o_orderkey", lib.in_quiet_hours(c("o_orderkey", 24), c("o_custkey", 24), c("o_custkey", 13)).alias("quiet"))


@query("resolve_edition", with_views("stories", f"{pq.S}, {pq.FAN}, i AS (SELECT DISTINCT dir FROM fan WHERE tier <> 'city' OR city_no % 2 = 0), p AS (SELECT *, 'feeds/' || lower(country) || '/' || replace(lower(state), '_', '-') || '/' AS base FROM s), c AS (SELECT story_id, unnest(CASE WHEN country = 'US' THEN [(1, base || 'city-' || city_no || '/'), (2, base || 'regions/' || lower(coalesce(metro, '-')) || '/'), (3, base || 'state/'), (4, 'feeds/us/national/')] ELSE [(1, base || 'city-' || city_no || '/'), (5, 'feeds/world/')] END) AS k FROM p) SELECT story_id AS place_id, arg_min(dir, k[1]) || 'latest.json' AS path FROM c JOIN i ON dir = k[2] GROUP BY story_id"))
def resolve_edition(spark, d):
    s = pq.stories(spark, d)
    index = publish.fan_out_feeds(s).filter("tier <> 'city' OR city_no % 2 = 0").select(F.concat("dir", F.lit("latest.json")).alias("path")).distinct()
    return lib.resolve_edition(s.withColumnRenamed("story_id", "place_id"), index, "morning")


@query("fetch_state", "SELECT user_id AS source_id, arg_max(event_type, event_id) AS etag, arg_max(event_type = 'error', event_id) AS permanent, max(event_id) AS at_s FROM events GROUP BY user_id")
def fetch_state(spark, d):
    log = table(spark, d, "events").selectExpr("user_id AS source_id", "event_type AS etag", "props AS last_modified", "props AS final_url", "event_type = 'error' AS permanent", "event_id AS at_s")
    return lib.fetch_state(log).select("source_id", "etag", "permanent", "at_s")


@query("source_health", f"WITH i AS (SELECT l_suppkey AS source_id, count(*) AS n, max(CASE WHEN l_suppkey % 5 > 0 THEN epoch(l_shipdate)::BIGINT END) AS newest FROM lineitem WHERE l_suppkey % 9 > 0 GROUP BY 1) SELECT s_suppkey AS source_id, coalesce(n, 0) AS n_items, newest AS newest_s, list_filter([CASE WHEN n IS NULL THEN 'empty' END, CASE WHEN n > 0 AND newest IS NULL THEN 'no-dates' END, CASE WHEN newest < {NOW} - 7 * 86400 THEN 'stale' END, CASE WHEN s_suppkey % 4 = 0 THEN 'redirected' END], lambda x: x IS NOT NULL) AS issues FROM supplier LEFT JOIN i ON s_suppkey = source_id")
def source_health(spark, d):
    i = table(spark, d, "lineitem").filter("l_suppkey % 9 > 0").select(F.col("l_suppkey").alias("source_id"), F.when(F.col("l_suppkey") % 5 > 0, F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("published_s"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"))
    return lib.source_health(i, s.withColumn("permanent", F.col("source_id") % 4 == 0), s, NOW)


@query("pick_image", "SELECT o_orderkey AS story_id, CASE WHEN o_orderkey % 6 < 2 AND o_orderkey % 5 > 0 THEN 'https://own/' || o_orderkey WHEN o_custkey % 3 = 0 THEN 'https://a/' || o_orderkey WHEN o_custkey % 3 = 1 THEN 'https://b/' || o_orderkey END AS url FROM orders")
def pick_image(spark, d):
    o = table(spark, d, "orders")
    own = o.selectExpr("o_orderkey AS story_id", "concat('https://own/', o_orderkey) AS url", f"{sources_mode()} AS rights_mode", "o_orderkey % 5 > 0 AS allow_reuse")
    c = o.selectExpr("o_orderkey AS story_id", "'Old Mill' AS query", "1 AS query_no", "2 AS result_no", "'The old mill at dusk' AS title", "concat('https://a/', o_orderkey) AS url", "CASE WHEN o_custkey % 3 = 0 THEN 'CC BY 4.0' ELSE 'CC BY-NC 4.0' END AS license")
    more = o.selectExpr("o_orderkey", "'Old Mill'", "2", "1", "'Mill, old'", "concat('https://b/', o_orderkey)", "CASE WHEN o_custkey % 3 < 2 THEN 'CC0' ELSE 'GFDL' END")
    lost = o.selectExpr("o_orderkey", "'Old Mill'", "1", "1", "'Windmill'", "concat('https://c/', o_orderkey)", "'CC0'")
    return lib.pick_image(o.select(F.col("o_orderkey").alias("story_id")), own, c.union(more).union(lost)).select("story_id", "url")


def sources_mode() -> str:
    from newsgrid.plans.views import RIGHTS_OF

    return RIGHTS_OF.format(k="o_orderkey")


W = "w AS (SELECT event_id, user_id AS bucket, ts, value / 10 - 15 AS temp, CASE WHEN event_type <> 'click' THEN event_id % 100 END AS rh, CASE WHEN event_type <> 'view' THEN event_id % 60 END AS kph, event_type FROM events)"


def points(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "user_id AS bucket", "ts AS at", "value / 10 - 15 AS temp_c", "CASE WHEN event_type <> 'click' THEN event_id % 100 END AS humidity", "CASE WHEN event_type <> 'view' THEN event_id % 60 END AS wind_kph", "event_id % 101 AS precip", "event_type AS condition")


@query("feels_like", f"""WITH {W}, f AS (SELECT *, temp * 9 / 5 + 32 AS f, kph * 0.621371 AS mph, rh::DOUBLE AS r FROM w), h AS (SELECT *, -42.379 + 2.04901523 * f + 10.14333127 * r - 0.22475541 * f * r - 0.00683783 * f * f - 0.05481717 * r * r + 0.00122874 * f * f * r + 0.00085282 * f * r * r - 0.00000199 * f * f * r * r AS hi FROM f),
a AS (SELECT *, CASE WHEN r < 13 AND f BETWEEN 80 AND 112 THEN hi - (13 - r) / 4 * sqrt((17 - abs(f - 95)) / 17) WHEN r > 85 AND f BETWEEN 80 AND 87 THEN hi + (r - 85) / 10 * ((87 - f) / 5) ELSE hi END AS h2 FROM h)
SELECT event_id, round(CASE WHEN rh IS NOT NULL AND f >= 80 THEN (h2 - 32) * 5 / 9 WHEN kph IS NOT NULL AND f <= 50 AND mph > 3 THEN (35.74 + 0.6215 * f - 35.75 * pow(mph, 0.16) + 0.4275 * f * pow(mph, 0.16) - 32) * 5 / 9 ELSE temp END, 5)::DOUBLE AS feels FROM a""")
def feels_like(spark, d):
    return points(spark, d).select("event_id", F.round(wx.feels_like_c(F.col("temp_c"), F.col("humidity"), F.col("wind_kph")), 5).alias("feels"))


@query("weather_bucket", "SELECT event_id, printf('%.1f,%.1f', round_even(value * 10 / 10 * 10, 0) / 10 / 10 * 10, round_even(-value, 0)) AS key FROM events")
def weather_bucket(spark, d):
    return table(spark, d, "events").select("event_id", wx.bucket_key(F.col("value"), F.rint(-F.col("value"))).alias("key"))


@query("display_temp", f"WITH {W} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round_even(temp * 9 / 5 + 32, 0)::INT || '°F' ELSE round_even(temp, 0)::INT || '°C' END AS shown FROM w")
def display_temp(spark, d):
    return points(spark, d).select("event_id", wx.display_temp(F.col("temp_c"), F.when(F.col("event_id") % 2 == 0, "us").otherwise("FR")).alias("shown"))


@query("parse_wind", "SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN (5 + event_id % 30) * 1.60934 WHEN 1 THEN (5 + 5 + event_id % 30) / 2.0 * 1.60934 WHEN 2 THEN (event_id % 30)::DOUBLE END, 6)::DOUBLE AS kph FROM events")
def parse_wind(spark, d):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN concat(5 + event_id % 30, ' mph') WHEN 1 THEN concat('5 to ', 5 + event_id % 30, ' mph') WHEN 2 THEN concat(event_id % 30, ' km/h') ELSE 'calm' END")
    return table(spark, d, "events").select("event_id", F.round(wx.parse_wind_kph(text), 6).alias("kph"))


@query("compass", "SELECT event_id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][(floor((event_id * 7 % 720) % 360 / 45.0 + 0.5)::INT % 8) + 1] AS point FROM events")
def compass(spark, d):
    return table(spark, d, "events").select("event_id", wx.compass((F.col("event_id") * 7 % 720).cast("double")).alias("point"))


@query("condition", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'THUNDERSTORM' WHEN 1 THEN 'SHOWERS' WHEN 2 THEN 'PARTLY_CLOUDY' WHEN 3 THEN 'SLEET' WHEN 4 THEN 'CLEAR' WHEN 5 THEN 'UNKNOWN' ELSE 'RAIN' END AS by_text, CASE event_id % 4 WHEN 0 THEN 'PARTLY_CLOUDY' WHEN 1 THEN 'RAIN' WHEN 2 THEN 'THUNDERSTORM' ELSE 'UNKNOWN' END AS by_symbol FROM events")
def condition(spark, d):
    e = F.col("event_id")
    text = F.element_at(F.array(*map(F.lit, ("Chance Thunder", "Rain Showers", "Mostly Cloudy", "Freezing Rain", "Fair", "Odd", "Sunny"))), (e % 7 + 1).cast("int"))
    icon = F.when(e % 7 == 6, "https://x/icons/land/day/rain,40?size=medium").when(e % 7 == 5, "https://x/icons/unknown")
    symbol = F.element_at(F.array(*map(F.lit, ("fair_day", "heavyrain", "lightrainandthunder_night", "other"))), (e % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", wx.condition(text, icon).alias("by_text"), wx.symbol_condition(symbol).alias("by_symbol"))


@query("daily_series", """WITH l AS (SELECT user_id AS bucket, ts + INTERVAL 9 HOUR AS t, value / 10 - 15 AS temp, event_id % 101 AS precip, event_type FROM events),
g AS (SELECT bucket, t::DATE AS day, max(temp) AS hi, min(temp) AS lo, max(precip) AS precip, arg_min(event_type, (abs(hour(t) - 13), t)) AS condition, count(*) AS n FROM l GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY bucket) AS days, first_value(n) OVER w AS n1 FROM g WINDOW w AS (PARTITION BY bucket ORDER BY day))
SELECT bucket, strftime(day, '%Y-%m-%d') AS day, round(hi, 6)::DOUBLE AS hi, round(lo, 6)::DOUBLE AS lo, precip, condition FROM o WHERE i > CASE WHEN days > 7 AND n1 < 6 THEN 1 ELSE 0 END AND i <= 7 + CASE WHEN days > 7 AND n1 < 6 THEN 1 ELSE 0 END""")
def daily_series(spark, d):
    out = weather.daily_series(points(spark, d), "Asia/Tokyo")
    return out.select("bucket", F.col("day").cast("string").alias("day"), F.round("hi", 6).alias("hi"), F.round("lo", 6).alias("lo"), "precip", "condition")


@query("first_hours", "SELECT event_id, user_id AS bucket FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) <= 24")
def first_hours(spark, d):
    return weather.first_hours(points(spark, d)).select("event_id", "bucket")


@query("pair_periods", """WITH p AS (SELECT user_id AS bucket, event_id, value AS temp, event_id % 101 AS precip, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
q AS (SELECT a.bucket, (a.rn - 1) // 2 AS pair, greatest(a.temp, coalesce(b.temp, a.temp)) AS hi, CASE WHEN a.bucket % 2 = 0 THEN coalesce(b.temp, a.temp) ELSE a.temp END AS lo, greatest(a.precip, coalesce(b.precip, a.precip)) AS precip, CASE WHEN a.bucket % 2 = 0 OR b.bucket IS NULL THEN a.event_type ELSE b.event_type END AS condition
  FROM p a LEFT JOIN p b ON a.bucket = b.bucket AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1) SELECT bucket, hi, lo, precip, condition FROM q WHERE pair < 7""")
def pair_periods(spark, d):
    p = points(spark, d).withColumn("temp_c", (F.col("temp_c") + 15) * 10).drop("temp_c")
    p = p.join(table(spark, d, "events").select("event_id", F.col("value").alias("temp_c")), "event_id").withColumn("place", F.col("event_id")).withColumn("daytime", F.col("bucket") % 2 == 0)
    return weather.pair_periods(p).select("bucket", "hi", "lo", "precip", "condition")


@query("new_warnings", "SELECT event_id AS alert_id FROM events WHERE event_type = 'error' AND (value > 300 OR event_id % 3 = 0) AND event_id % 5 > 0")
def new_warnings(spark, d):
    a = table(spark, d, "events").filter("event_type = 'error'").selectExpr("event_id AS alert_id", "CASE WHEN event_id % 3 = 0 THEN 'Storm Warning' ELSE 'Watch' END AS event", "CASE WHEN value > 300 THEN 'SEVERE' END AS severity")
    return weather.new_warnings(a, a.filter("alert_id % 5 = 0")).select("alert_id")


@query("order_alerts", "SELECT event_id AS alert_id, event_id % 5 + 1 AS severity_rank FROM events ORDER BY severity_rank, event_id")
def order_alerts(spark, d):
    a = table(spark, d, "events").selectExpr("event_id AS alert_id", "element_at(array('Extreme', 'Severe', 'MODERATE', 'minor', 'odd'), cast(event_id % 5 + 1 AS int)) AS severity", "event_id AS effective")
    return weather.order_alerts(a).select("alert_id", F.col("severity_rank").cast("long").alias("severity_rank"))


@query("merge_weather", "SELECT c_custkey AS bucket, CASE WHEN c_custkey % 3 > 0 THEN 'p' ELSE 's' END AS forecast, c_custkey % 3 = 0 AS fallback, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END AS n_alerts, CASE WHEN c_custkey % 5 = 0 THEN least(50, CASE WHEN c_custkey % 3 > 0 THEN c_custkey ELSE 70 END) WHEN c_custkey % 3 > 0 THEN c_custkey ELSE 70 END AS expires_at FROM customer")
def merge_weather(spark, d):
    c = table(spark, d, "customer")
    p = c.filter("c_custkey % 3 > 0").selectExpr("c_custkey AS bucket", "'p' AS forecast", "c_custkey AS expires_at")
    s = c.selectExpr("c_custkey AS bucket", "'s' AS forecast", "70L AS expires_at")
    return weather.merge_weather(p, s, c.filter("c_custkey % 5 = 0").selectExpr("c_custkey AS bucket", "2 AS n_alerts", "50L AS expires_at"))


@query("cache_state", "WITH e AS (SELECT user_id AS key, event_id AS at_s, event_id + 500 AS expires_s, CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'view' THEN 304 ELSE 200 END AS status FROM events), n AS (SELECT 9500 AS now), b AS (SELECT key, arg_max(at_s, at_s) AS at_s, arg_max(CASE WHEN status = 304 THEN at_s + 100 ELSE expires_s END, at_s) AS x FROM e WHERE status <> 500 GROUP BY key), l AS (SELECT key, arg_max(status, at_s) AS status FROM e GROUP BY key) SELECT key, CASE WHEN at_s IS NULL THEN 'none' WHEN now < x OR now - at_s < 100 THEN 'fresh' WHEN status = 500 THEN 'stale' ELSE 'expired' END AS state FROM l LEFT JOIN b USING (key), n")
def cache_state(spark, d):
    log = table(spark, d, "events").selectExpr("user_id AS key", "event_id AS at_s", "event_id + 500 AS expires_s", "CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'view' THEN 304 ELSE 200 END AS status")
    return weather.cache_state(log, 9500, 100)


@query("filter_sources", with_views("sources", "SELECT source_id FROM sources WHERE enabled AND rights_mode <> 'BLOCKED' AND type NOT IN ('gdelt')"))
def filter_sources(spark, d):
    return normalize.filter_sources(sources(spark, d), {"gdelt": False, "nws-alerts": True}).select("source_id")


@query("check_registry", with_views("sources", "SELECT source_id, 'duplicate id' AS problem FROM sources WHERE source_id % 10 = 0 UNION ALL SELECT source_id, 'no license' FROM sources WHERE rights_mode = 'OPEN_LICENSE' AND source_id % 4 > 0 UNION ALL SELECT source_id, 'no license' FROM sources WHERE rights_mode = 'OPEN_LICENSE' AND source_id % 4 > 0 AND source_id % 10 = 0"))
def check_registry(spark, d):
    s = sources(spark, d).selectExpr("source_id", "rights_mode", "CASE WHEN source_id % 4 = 0 THEN 'CC BY' END AS license")
    return normalize.check_registry(s.union(s.filter("source_id % 10 = 0")))


@query("build_queries", "SELECT s_suppkey AS source_id, '\"A\" OR \"B\" OR \"' || n_name || '\"' || CASE WHEN s_suppkey % 2 = 0 THEN ' OR \"X County\"' ELSE '' END AS query FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def build_queries(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS source_id", "s_nationkey AS admin1", "array('A', 'B', '') AS cities", "CASE WHEN s_suppkey % 2 = 0 THEN array('X County') END AS counties")
    return normalize.build_queries(s, table(spark, d, "nation").selectExpr("n_nationkey AS admin1", "n_name AS state_name"))


@query("parse_gdelt", "SELECT c_custkey AS source_id, c_name AS title, 'https://h' || c_nationkey || '.org/a' AS url, CASE WHEN c_custkey % 2 = 0 THEN 'd.org' ELSE 'h' || c_nationkey || '.org' END AS publisher, 1704103445 AS at FROM customer")
def parse_gdelt(spark, d):
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("https://h"), F.col("c_nationkey").cast("string"), F.lit(".org/a")).alias("url"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, "20240101T100405Z").otherwise("2024-01-01T10:04:05Z").alias("seendate"), F.when(F.col("c_custkey") % 2 == 0, "d.org").alias("domain")), F.struct(F.lit("https://x").alias("url"), F.lit(" ").alias("title"), F.lit("").alias("seendate"), F.lit("").alias("domain"))).alias("articles")))
    raw = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), body.alias("body"))
    return feeds.parse_gdelt(raw).select("source_id", "title", "url", "publisher", F.unix_seconds("published_at").cast("int").alias("at"))


@query("parse_quakes", "SELECT event_id AS source_id, 'M ' || value AS title, 'https://q/' || event_id AS url, 1704067200 + event_id AS at FROM events")
def parse_quakes(spark, d):
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("value").alias("mag"), F.concat(F.lit("M "), F.col("value").cast("string")).alias("title"), ((F.lit(1704067200) + F.col("event_id")) * 1000).alias("time"), F.concat(F.lit("https://q/"), F.col("event_id").cast("string")).alias("url")).alias("properties"))).alias("features")))
    return feeds.parse_quakes(table(spark, d, "events").select(F.col("event_id").alias("source_id"), body.alias("body"))).select("source_id", "title", "url", F.unix_seconds("published_at").alias("at"))


@query("parse_alerts", "SELECT event_id AS source_id, CASE WHEN event_id % 2 = 0 THEN 'Head' ELSE event_type END AS title, CASE WHEN event_id % 3 = 0 THEN 'https://a/' || event_id ELSE 'https://feed' END AS url, CASE WHEN event_id % 5 = 0 THEN 'What' ELSE 'What' || chr(10) || chr(10) || 'Do' END AS summary_html FROM events")
def parse_alerts(spark, d):
    e = F.col("event_id")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(e % 3 == 0, F.concat(F.lit("https://a/"), e.cast("string"))).alias("@id"), F.col("event_type").alias("event"), F.when(e % 2 == 0, "Head").alias("headline"), F.lit("What").alias("description"), F.when(e % 5 > 0, "Do").alias("instruction"), F.lit("2024-01-01T00:00:00Z").alias("sent")).alias("properties"))).alias("features")))
    return feeds.parse_alerts(table(spark, d, "events").select(e.alias("source_id"), F.lit("https://feed").alias("feed_url"), body.alias("body"))).select("source_id", "title", "url", "summary_html")


@query("build_gazetteer", "SELECT p_name || p_partkey AS name, p_brand AS country, p_partkey * 40 AS population FROM part WHERE p_partkey * 40 >= 50000 AND p_partkey % 7 > 0 ORDER BY population DESC, name, country LIMIT 1000")
def build_gazetteer(spark, d):
    """IO13; the limit is the feature."""
    p = table(spark, d, "part")
    name = F.concat("p_name", F.col("p_partkey").cast("string"))
    fields = [F.lit("0"), name, *[F.lit("x")] * 6, F.col("p_brand"), *[F.lit("y")] * 5, (F.col("p_partkey") * 40).cast("string"), F.lit("z")]
    seed = p.filter("p_partkey % 7 = 0").select(F.col("p_brand").alias("country"), name.alias("name"))
    return feeds.build_gazetteer(p.select(F.concat_ws("\t", *fields).alias("value")), seed).select("name", "country", "population")


@query("build_municipalities", "SELECT DISTINCT lower(c_mktsegment) || ' ' || c_nationkey AS name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 < 2 ORDER BY name")
def build_municipalities(spark, d):
    line = F.concat_ws("\t", F.when(F.col("c_custkey") % 2 == 0, "NY").otherwise("OH"), F.lit("1"), F.lit("2"), F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" village")), F.lit("47"), F.element_at(F.array(F.lit("A"), F.lit("S"), F.lit("N")), (F.col("c_custkey") % 3 + 1).cast("int")))
    return feeds.build_municipalities(table(spark, d, "customer").select(line.alias("value")), "NY")


@query("run_summary", "SELECT (SELECT count(*) FROM supplier) AS checked, (SELECT count(*) FROM documents) AS discovered, (SELECT count(*) FROM documents WHERE doc_id % 3 > 0) AS normalised, (SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS dropped, (SELECT count(*) FROM supplier WHERE s_suppkey % 9 = 0) AS failed, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS new, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS updated, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS unchanged")
def run_summary(spark, d):
    i = table(spark, d, "documents")
    raw = table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"))
    status = table(spark, d, "orders").selectExpr("CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'updated' ELSE 'unchanged' END AS status")
    return feeds.run_summary(raw, i, i.filter("doc_id % 3 > 0"), raw.filter("source_id % 9 = 0"), status)


@query("shift_to_now", with_views("items", "SELECT item_id, ts - (SELECT max(ts) FROM items) + 1800000000 - 3600 AS ts FROM items"))
def shift_to_now(spark, d):
    return feeds.shift_to_now(items(spark, d), F.timestamp_seconds(F.lit(1800000000))).select("item_id", F.unix_seconds("published_at").alias("ts"))
