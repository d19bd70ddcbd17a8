"""Queries over URLs, markup, headlines, entities and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid import vocab
from newsgrid.functions import text as x
from newsgrid.plans.registry import query
from newsgrid.plans.views import items, sources, table, with_views

HEAD = f"list_filter(string_split(regexp_replace(lower(headline), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in vocab.HEADLINE_STOP_WORDS)}))"
CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{name}'" for name, words in vocab.CATEGORY_KEYWORDS) + " ELSE 'local' END"
ENTITIES = f"list_distinct(list_transform(list_filter(regexp_extract_all(regexp_replace(t, '[À-ɏ]', '_', 'g'), '\\b([A-Z][a-z]{{2,}}(?:\\s+[A-Z][a-z]{{2,}})*)\\b', 1), lambda s: s NOT IN ({', '.join(repr(w) for w in vocab.ENTITY_STOP_WORDS)})), lambda s: lower(s)))"
URL = r"""parts AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host,
  coalesce(nullif(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
kept AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'fbclid=') AND NOT starts_with(p, 'gclid=') AND NOT starts_with(p, 'amp='))) AS q FROM parts),
urls AS (SELECT page_id, scheme || '://' || host || CASE WHEN rtrim(path, '/') LIKE '%/amp' THEN rtrim(path, '/')[:-5] ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM kept)"""
STRIP = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
TEXT = f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace({STRIP}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("canonicalize_url", f"WITH {URL} SELECT page_id, url FROM urls")
def canonicalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", x.canonicalize_url(F.col("url")).alias("url"))


@query("item_id", f"WITH {URL} SELECT page_id, substr(sha256(url), 1, 32) AS item_id, substr(sha256(url), 1, 16) AS event_id FROM urls")
def item_id(spark, d):
    url = x.canonicalize_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", x.item_id(url).alias("item_id"), x.event_id(url).alias("event_id"))


@query("html_to_text", f"SELECT page_id, {TEXT} AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", x.html_to_text(F.col("html")).alias("text"))


@query("html_to_text_all")
def html_to_text_all(spark, d):
    """N2 with all entities, which SQL has no table for."""
    return table(spark, d, "pages").select("page_id", x.html_to_text_all(F.col("html")).alias("text"))


@query("strip_replacement", "SELECT doc_id, replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, 'a', chr(65533)) ELSE text END, chr(65533), '') AS text FROM documents")
def strip_replacement(spark, d):
    damaged = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("a"), F.lit(x.REPLACEMENT))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", x.strip_replacement(damaged).alias("text"))


@query("truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN regexp_replace(text[:200], '\\s+$', '') ELSE text END AS text FROM documents")
def truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", x.truncate(F.col("text"), 200).alias("text"))


@query("normalize_headline", with_views("items", f"SELECT item_id, array_to_string({HEAD}, ' ') AS headline FROM items"))
def normalize_headline(spark, d):
    return items(spark, d).select("item_id", x.normalize_headline(F.col("headline")).alias("headline"))


@query("classify_category", with_views("items", f"t AS (SELECT item_id, source_id, lower(headline || ' ' || excerpt) AS t FROM items) SELECT item_id, CASE WHEN source_id = 'src0' THEN 'weather' WHEN source_id = 'src1' AND (contains(t, 'earthquake') OR contains(t, 'magnitude') OR contains(t[:8], 'm ')) THEN 'science' ELSE {CATEGORY} END AS category FROM t"))
def classify_category(spark, d):
    kind = F.when(F.col("source_id") == "src0", "nws-alerts").when(F.col("source_id") == "src1", "json-api").otherwise("rss")
    return items(spark, d).select("item_id", x.classify_category(F.col("headline"), F.col("excerpt"), kind).alias("category"))


@query("extract_entities", f"SELECT doc_id, list_sort({ENTITIES}) AS entities FROM (SELECT doc_id, text AS t FROM documents)")
def extract_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(x.extract_entities(F.col("text"))).alias("entities"))


@query("place_aliases", r"""WITH n AS (SELECT c_custkey, trim(lower(CASE c_custkey % 4 WHEN 0 THEN 'St. ' WHEN 1 THEN 'Mount ' WHEN 2 THEN 'ft ' ELSE '' END || c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' County' WHEN 1 THEN ' village' ELSE '' END)) AS n FROM customer)
SELECT c_custkey, list_sort(list_distinct(list_filter(list_concat([n, regexp_replace(n, '\s+(county|village)$', '')], CASE c_custkey % 4
 WHEN 0 THEN [n[5:], 'st ' || n[5:], 'saint ' || n[5:]] WHEN 1 THEN [n[7:], 'mt. ' || n[7:], 'mt ' || n[7:]] WHEN 2 THEN [n[4:], 'ft. ' || n[4:], 'fort ' || n[4:]] ELSE [] END), lambda x: x <> ''))) AS aliases FROM n""")
def place_aliases(spark, d):
    name = F.expr("concat(CASE c_custkey % 4 WHEN 0 THEN 'St. ' WHEN 1 THEN 'Mount ' WHEN 2 THEN 'ft ' ELSE '' END, c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN ' County' WHEN 1 THEN ' village' ELSE '' END)")
    return table(spark, d, "customer").select("c_custkey", x.place_aliases(name).alias("aliases"))


@query("snippet", with_views("items", r"""w AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '' ELSE excerpt END AS e, headline AS h, headline || ' ' || excerpt AS b FROM items),
p AS (SELECT *, coalesce(nullif(trim(e), ''), CASE WHEN length(b) > 160 THEN regexp_replace(b[:160], '\s+\S*$', '') || '…' ELSE b END) AS best FROM w),
t AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(lower(best), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS mine, list_filter(string_split(regexp_replace(lower(h), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS theirs FROM p)
SELECT item_id, CASE WHEN len(mine) > 0 AND len(list_intersect(mine, theirs)) < 0.75 * len(mine) THEN best END AS snippet FROM t"""))
def snippet(spark, d):
    e = F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("excerpt"))
    return items(spark, d).select("item_id", x.snippet(F.lit(None).cast("string"), e, F.concat_ws(" ", "headline", "excerpt"), F.col("headline")).alias("snippet"))


@query("photo_matches_place", r"""WITH w AS (SELECT p_partkey, list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2) AS a, ['small', 'widgetry', 'economics'] AS b FROM part)
SELECT p_partkey, len(list_filter(a, lambda p: len(list_filter(b, lambda q: p = q OR length(q) >= 6 AND starts_with(p, q) OR length(p) >= 6 AND starts_with(q, p))) > 0)) > 0 AS matches FROM w""")
def photo_matches_place(spark, d):
    return table(spark, d, "part").select("p_partkey", x.photo_matches_place(F.concat_ws(" ", "p_name", "p_type"), F.array(F.lit("Small Widgetry"), F.lit("Economics"))).alias("matches"))


LICENSES = "CASE p_partkey % 9 WHEN 0 THEN 'CC BY-SA 4.0' WHEN 1 THEN 'CC BY-NC 2.0' WHEN 2 THEN 'CC0' WHEN 3 THEN 'Public domain' WHEN 4 THEN 'CC BY-ND 3.0' WHEN 5 THEN 'cc-by-2.5' WHEN 6 THEN 'GFDL' WHEN 7 THEN 'Attribution-NonCommercial' ELSE NULL END"


@query("is_allowed_license", "SELECT p_partkey, p_partkey % 9 IN (0, 2, 3, 5) AS allowed FROM part")
def is_allowed_license(spark, d):
    return table(spark, d, "part").select("p_partkey", x.is_allowed_license(F.expr(LICENSES)).alias("allowed"))


@query("normalize_postal", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lpad(c_custkey::VARCHAR, 5, '0') WHEN 1 THEN lpad(c_custkey::VARCHAR, 5, '0') WHEN 2 THEN NULL ELSE 'AB ' || c_custkey END AS postal FROM customer")
def normalize_postal(spark, d):
    code = F.expr("CASE c_custkey % 4 WHEN 0 THEN lpad(c_custkey, 5, '0') WHEN 1 THEN concat(lpad(c_custkey, 5, '0'), '-1234') WHEN 2 THEN 'x1' ELSE concat(' ab  ', c_custkey) END")
    return table(spark, d, "customer").select("c_custkey", x.normalize_postal(code, F.when(F.col("c_custkey") % 4 == 3, "GB").otherwise("us")).alias("postal"))


@query("title_matches", r"""WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS t, list_filter(['small', lower(p_type)], lambda w: length(w) >= 3) AS q FROM part)
SELECT p_partkey, len(list_filter(q, lambda w: NOT list_contains(t, w))) = 0 AS matches FROM w""")
def title_matches(spark, d):
    return table(spark, d, "part").select("p_partkey", x.title_matches(F.concat_ws(" ", "p_name", "p_type"), F.concat(F.lit("A Small "), "p_type")).alias("matches"))


@query("image_queries", with_views("items", f"e AS (SELECT item_id, source_id, {ENTITIES} AS e FROM (SELECT item_id, source_id, headline || ' ' || excerpt AS t FROM items)), q AS (SELECT item_id, list_concat([lower(source_id)], list_filter(e, lambda n: len(string_split(n, ' ')) BETWEEN 2 AND 5 AND length(n) <= 60), ['north county', 'metro']) AS q FROM e) SELECT item_id, len(list_distinct(q)) AS n, q[1] AS first FROM q"))
def image_queries(spark, d):
    e = x.extract_entities(F.concat_ws(" ", "headline", "excerpt"))
    q = x.image_queries(F.col("source_id"), e, F.lit("North County"), F.lit("metro"), 1000)
    return items(spark, d).select("item_id", q.alias("q")).select("item_id", F.size("q").cast("long").alias("n"), F.element_at("q", 1).alias("first"))


@query("rights", with_views("sources", """SELECT source_id, CASE WHEN rights_mode IN ('PUBLIC_DOMAIN', 'OPEN_LICENSE') THEN 2000 WHEN rights_mode = 'RSS_EXCERPT_ALLOWED' THEN 300 ELSE 0 END AS excerpt_limit,
  rights_mode IN ('PUBLIC_DOMAIN', 'OPEN_LICENSE', 'RSS_EXCERPT_ALLOWED') AS excerpt_allowed, rights_mode NOT IN ('LINK_ONLY', 'BLOCKED') AS feeds_text,
  rights_mode IN ('PUBLIC_DOMAIN', 'OPEN_LICENSE') AS image_reuse, rights_mode <> 'BLOCKED' AS ingestible FROM sources"""))
def rights(spark, d):
    from newsgrid.operators.normalize import rights_of

    r = rights_of(F.col("rights_mode"))
    return sources(spark, d).select("source_id", *[r[n].alias(n) for n in ("excerpt_limit", "excerpt_allowed", "feeds_text", "image_reuse", "ingestible")])


@query("screen_raw", "SELECT page_id, length(html) > 20000 AS too_long FROM pages WHERE NOT regexp_matches(upper(html[:200000]), '<!(ENTITY|ELEMENT)')")
def screen_raw(spark, d):
    """IO5 and IO12 over pages, with a size cap that the tables reach."""
    from newsgrid.sources.feeds import is_hostile

    return table(spark, d, "pages").filter(~is_hostile(F.col("html"))).select("page_id", (F.length("html") > 20000).alias("too_long"))


@query("normalize_items", with_views("items sources", """s AS (SELECT 'src' || source_id AS source_id, any_value(name) AS name, any_value(rights_mode) AS rights_mode FROM sources GROUP BY 1)
SELECT item_id, substr(sha256(url), 1, 32) AS id, coalesce(name, '') AS publisher, headline[:200] AS headline,
  CASE WHEN coalesce(rights_mode, 'METADATA_ONLY') IN ('PUBLIC_DOMAIN', 'OPEN_LICENSE') AND excerpt <> '' THEN regexp_replace(excerpt[:2000], '\\s+$', '') WHEN rights_mode = 'RSS_EXCERPT_ALLOWED' AND excerpt <> '' THEN regexp_replace(excerpt[:300], '\\s+$', '') END AS excerpt, url, ts
FROM items LEFT JOIN s USING (source_id) WHERE headline <> '' AND ts <= 1706000000 + 3600"""))
def normalize_items(spark, d):
    from newsgrid.operators.normalize import normalize

    raw = items(spark, d).select("item_id", "source_id", F.col("headline").alias("title"), F.replace(F.replace("excerpt", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("summary_html"), "url", "published_at")
    src = sources(spark, d).withColumn("source_id", F.concat(F.lit("src"), F.col("source_id").cast("string"))).withColumn("language", F.lit("en"))
    out = normalize(raw, src, F.timestamp_seconds(F.lit(1706000000)))
    return out.select("item_id", "id", "publisher", "headline", "excerpt", "url", F.unix_seconds("published_at").alias("ts"))
