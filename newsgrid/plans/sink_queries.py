"""Queries of tables that are written into the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgrid.checkpoint import ensure_checkpoint_dir
from newsgrid.operators import publish
from newsgrid.plans import publish_queries as pq
from newsgrid.plans.registry import query
from newsgrid.plans.views import table, with_views
from newsgrid.sources import feeds


def folder(spark, name: str) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("registry_scan", "SELECT 's-' || s_suppkey AS id, s_name AS name, 'US' AS country, s_suppkey % 101 AS priority FROM supplier WHERE s_suppkey % 7 <> 0")
def registry_scan(spark, d):
    at = folder(spark, "registry")
    entry = F.expr("struct(concat('s-', s_suppkey) AS id, s_name AS name, struct('US' AS country) AS coverage, s_suppkey % 7 <> 0 AS enabled, cast(s_suppkey % 101 AS int) AS priority)")
    # a file holds an array of a hundred entries
    some = table(spark, d, "supplier").groupBy(F.expr("s_suppkey div 100").alias("part")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    some.write.partitionBy("part").text(at)
    return feeds.read_sources(spark, at).selectExpr("id", "name", "coverage.country AS country", "cast(priority AS bigint) AS priority")


@query("write_stage", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'r2' ELSE 'r1' END AS run_id FROM orders UNION ALL SELECT o_orderkey, 'r2' FROM orders WHERE o_orderkey % 3 = 1")
def write_stage(spark, d):
    at, o = folder(spark, "stage"), table(spark, d, "orders").select("o_orderkey")
    feeds.write_stage(o.filter("o_orderkey % 3 > 0"), at, "r1")
    feeds.write_stage(o.filter("o_orderkey % 3 < 2"), at, "r2")
    return spark.read.parquet(at)


def opened(spark, at: str, wholetext: bool):
    """Files below a folder: path (relative to it) and value, a row for each file or line."""
    rows = spark.read.option("recursiveFileLookup", True).option("wholetext", wholetext).text(at)
    return rows.select(F.substring_index(F.expr("url_decode(input_file_name())"), f"{at.rpartition('/')[2]}/", -1).alias("path"), "value")


@query("write_editions", with_views("stories", pq.ALL + "SELECT dir, kind, to_json(list(story_id ORDER BY place))::VARCHAR AS story_ids, dir || kind || '.json' AS path, count(*) AS story_count FROM rows GROUP BY dir, kind"))
def write_editions(spark, d):
    """IO16: what the files hold that stand at the paths of the index."""
    at = folder(spark, "editions")
    publish.write_editions(publish.editions(pq.editions_of(spark, d)), at)
    index = spark.read.schema("dir string, kind string, path string, story_count bigint").json(f"{at}/index")
    docs = opened(spark, f"{at}/editions", True).select("path", F.to_json(F.from_json("value", "story_ids array<bigint>")["story_ids"]).alias("story_ids"))
    return index.join(docs, "path")


@query("write_stories", "SELECT doc_id AS story_id, coalesce(text, '') AS body FROM documents")
def write_stories(spark, d):
    at = folder(spark, "stories")
    publish.write_stories(table(spark, d, "documents").select(F.col("doc_id").alias("story_id"), F.coalesce("text", F.lit("")).alias("body")), at)
    return spark.read.text(at).select(F.from_json("value", "story_id bigint, body string").alias("s")).select("s.*")


@query("write_location_slices", """SELECT lower(r_name) || '.json' AS path, c_custkey AS place_id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT lower(r_name) || '-postal.json', s_suppkey, 'z' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT unnest(['us.json', 'us-postal.json']), NULL, NULL UNION ALL SELECT DISTINCT lower(r_name) || unnest(['.json', '-postal.json']), NULL::INT, NULL FROM region""")
def write_location_slices(spark, d):
    """IO17: the lines of all slices, the first of each without a place; `us` has no place here and is written too."""
    at = folder(spark, "locations")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    places = table(spark, d, "customer").join(n, F.expr("c_nationkey = n_nationkey")).selectExpr("r_name AS country", "c_custkey AS place_id", "c_name AS name")
    postal = table(spark, d, "supplier").join(n, F.expr("s_nationkey = n_nationkey")).selectExpr("r_name AS country", "s_suppkey AS place_id", "concat('z', s_suppkey) AS name")
    publish.write_location_slices(places, at, postal)
    lines = opened(spark, at, False).select("path", F.from_json("value", "place_id bigint, name string").alias("p"))
    return lines.select("path", "p.*")
