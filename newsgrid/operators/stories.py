"""Story rows and evidence packs from clusters.

clusters: cluster_id, headline, category, version, tier, breaking, first_seen, last_seen, locations (array of structs).
members: cluster_id, item_id, source_id, publisher, headline, excerpt, url, published_at, rights_mode.
A cluster's reports are gathered into arrays; a cluster holds the reports of one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid.operators.normalize import rights_of

PAD = " — developing story"


def provenance_sources(members: DataFrame) -> DataFrame:
    """A10: (cluster_id, sources): publisher, headline, URL, time, rights and an excerpt of 300 characters at most, by time; reports without publisher, headline or URL are left out."""
    full = members.filter("coalesce(publisher, '') <> '' AND coalesce(headline, '') <> '' AND coalesce(url, '') <> ''")
    entry = F.struct("published_at", "item_id", "publisher", "headline", "url", "rights_mode", F.substring(F.nullif(F.trim("excerpt"), F.lit("")), 1, 300).alias("excerpt"))
    return full.groupBy("cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("sources"))


def _tier(c: str) -> Column:
    low = F.lower(F.coalesce(F.col(c), F.lit("low")))
    return F.when(low.isin("high", "medium"), low).otherwise("low")


def _locations(*options: Column) -> Column:
    kinds = [F.when(F.size(o) > 0, o) for o in options]
    return F.coalesce(*kinds)


def card_stories(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Story rows without a brief: the cluster's headline (short ones are padded), the newest excerpt there is, tier, sources."""
    newest = members.filter("coalesce(trim(excerpt), '') <> ''").groupBy("cluster_id").agg(F.max_by(F.substring(F.trim("excerpt"), 1, 300), F.struct("published_at", "item_id")).alias("excerpt"))
    head = F.substring(F.coalesce(F.nullif(F.col("headline"), F.lit("")), F.lit("Developing story")), 1, 200)
    head = F.when(F.length(head) < 8, F.substring(F.concat(head, F.lit(PAD)), 1, 200)).otherwise(head)
    rows = clusters.join(newest, "cluster_id", "left").join(provenance_sources(members), "cluster_id", "left")
    return rows.select(F.col("cluster_id").alias("story_id"), head.alias("headline"), F.lit(None).cast("string").alias("dek"), F.lit(None).cast("string").alias("body"), "excerpt", F.coalesce("category", F.lit("local")).alias("category"), F.col("first_seen").alias("published_at"), F.col("last_seen").alias("updated_at"), F.lit(False).alias("ai"), F.coalesce("version", F.lit(1)).alias("version"), _tier("tier").alias("tier"), F.coalesce("breaking", F.lit(False)).alias("breaking"), "locations", "sources")


def brief_stories(briefs: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Story rows of accepted briefs (event_id, headline, dek, body, category, locations), cut to the field limits; the cluster gives what the brief lacks."""
    b = briefs.select(F.col("event_id").alias("cluster_id"), F.substring("headline", 1, 200).alias("b_headline"), F.substring("dek", 1, 300).alias("dek"), F.substring("body", 1, 6000).alias("body"), F.nullif("category", F.lit("")).alias("b_category"), F.col("locations").alias("b_locations"))
    rows = b.join(clusters, "cluster_id").join(provenance_sources(members), "cluster_id", "left")
    return rows.select(F.col("cluster_id").alias("story_id"), F.col("b_headline").alias("headline"), "dek", "body", F.lit(None).cast("string").alias("excerpt"), F.coalesce("b_category", "category", F.lit("local")).alias("category"), F.col("first_seen").alias("published_at"), F.col("last_seen").alias("updated_at"), F.lit(True).alias("ai"), F.coalesce("version", F.lit(1)).alias("version"), _tier("tier").alias("tier"), F.coalesce("breaking", F.lit(False)).alias("breaking"), _locations(F.col("b_locations"), F.col("locations")).alias("locations"), "sources")


def evidence_pack(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, pack): JSON of what a brief may use: sources in order, excerpts only where rights allow text, place names, category.  clusters: cluster_id, category, places (array of names)."""
    allowed = rights_of(F.coalesce("rights_mode", F.lit("METADATA_ONLY")))
    text = F.when(allowed["feeds_text"] & (F.col("rights_mode") != "METADATA_ONLY"), F.substring(F.nullif(F.trim("excerpt"), F.lit("")), 1, 2000))
    view = F.struct(F.unix_seconds(F.col("published_at").cast("timestamp")).alias("published_s"), F.col("item_id").alias("id"), "source_id", "publisher", "headline", "rights_mode", text.alias("excerpt"))
    sources = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list(view)).alias("sources"))
    rows = clusters.join(sources, "cluster_id")
    return rows.select("cluster_id", F.to_json(F.struct("sources", "places", F.coalesce("category", F.lit("local")).alias("category_hint"))).alias("pack"))


def queue_manifest(queue: DataFrame) -> DataFrame:
    """The queued ids in order and their number; a queue is bounded by its limit."""
    return queue.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cluster_id"))), lambda x: x["cluster_id"]).alias("queued"), F.count(F.lit(1)).alias("n"))
