"""Aggregates, scores and confidence of event clusters.

members: cluster_id, item_id, source_id, published_at (timestamp) and, where used, publisher, headline, section,
category, rights_mode.  sources: source_id, name, type, rights_mode, priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid import vocab
from newsgrid.operators.state import reusable_briefs

SMALL_TABLE_ROWS = 200_000


def small(dim: DataFrame, most: int = SMALL_TABLE_ROWS) -> DataFrame:
    """dim, marked for broadcast only if it has at most `most` rows; larger ones are joined by a shuffle."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def seconds(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / 1e6


def is_official(type_: Column, rights: Column, name: Column) -> Column:
    """Feeds of public bodies, by type, rights or name."""
    named = F.lower(F.coalesce(name, F.lit("")))
    out = F.coalesce(type_.isin(*vocab.OFFICIAL_TYPES), F.lit(False)) | F.coalesce(rights == "PUBLIC_DOMAIN", F.lit(False))
    for part in vocab.OFFICIAL_NAMES:
        out = out | named.contains(part)
    return out


def attach_source(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Members with their source's priority (50 if unknown), official flag and rights."""
    dim = sources.select("source_id", F.coalesce(F.col("priority"), F.lit(50)).alias("priority"), is_official(F.col("type"), F.col("rights_mode"), F.col("name")).alias("official"), F.col("rights_mode").alias("source_rights"), F.lit(True).alias("known"))
    return members.join(small(dim), "source_id", "left").withColumns({"priority": F.coalesce("priority", F.lit(50)), "official": F.coalesce("official", F.lit(False)), "known": F.coalesce("known", F.lit(False))})


def publisher_key(source_id: Column, publisher: Column | None = None) -> Column:
    """Identity of a publisher, the source id or else the name; null if neither."""
    parts = [source_id.cast("string")] + ([publisher] if publisher is not None else [])
    return F.nullif(F.lower(F.trim(F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit("")))), F.lit(""))


def cluster_bounds(members: DataFrame) -> DataFrame:
    """A1: first and last report of each cluster, its size and its members in order."""
    return members.groupBy("cluster_id").agg(F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"), F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_list("item_id")).alias("member_ids"))


def cluster_section(members: DataFrame) -> DataFrame:
    """A3: the most specific section of the members; unknown ones count as world."""
    order = F.create_map(*[x for i, s in enumerate(vocab.SECTIONS) for x in (F.lit(s), F.lit(i))])
    rank = F.coalesce(order[F.col("section")], F.lit(4))
    return members.groupBy("cluster_id").agg(F.element_at(F.array(*map(F.lit, vocab.SECTIONS)), F.min(rank) + 1).alias("section"))


def cluster_category(members: DataFrame) -> DataFrame:
    """A4: the most common category; ties go to the one seen first."""
    first = members.groupBy("cluster_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("published_at", "item_id")).alias("first"))
    return first.groupBy("cluster_id").agg(F.min_by("category", F.struct(-F.col("n"), F.col("first"))).alias("category"))


def cluster_locations(members: DataFrame, k: int = 3) -> DataFrame:
    """A2: the k most frequent locations of each cluster, ties by first seen; members have a column `location`."""
    counted = members.filter(F.col("location").isNotNull()).groupBy("cluster_id", "location").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("published_at", "item_id")).alias("first"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).filter(F.col("place") <= k).select("cluster_id", "place", "location", "n")


def representative(members: DataFrame, sources: DataFrame) -> DataFrame:
    """A5: the member that speaks for a cluster: highest priority, link-only ones 100 lower, then the newest, then the first."""
    known = attach_source(members, sources)
    priority = F.col("priority") - F.when(F.col("source_rights") == "LINK_ONLY", 100).otherwise(0)
    return known.groupBy("cluster_id").agg(F.max_by("item_id", F.struct(priority, F.col("published_at"), -F.col("item_id"))).alias("item_id"))


def independent_publishers(members: DataFrame) -> DataFrame:
    """Number of distinct publishers."""
    key = publisher_key(F.col("source_id"))
    return members.groupBy("cluster_id").agg(F.count_distinct(key).alias("n_publishers"))


def confidence(members: DataFrame, sources: DataFrame) -> DataFrame:
    """HIGH for two publishers; one report: UNVERIFIED if link-only, MEDIUM from priority 70; else LOW."""
    known = attach_source(members, sources)
    key = publisher_key(F.col("source_id"))  # two that differ are enough, so none but the least and the greatest are held
    agg = known.groupBy("cluster_id").agg(F.coalesce(F.min(key) < F.max(key), F.lit(False)).alias("two"), F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("source_rights") == "LINK_ONLY", F.lit(False))).alias("links"), F.max("priority").alias("priority"))
    tier = F.when(F.col("two"), "HIGH").when(F.col("links"), "UNVERIFIED").when((F.col("n") == 1) & (F.col("priority") >= 70), "MEDIUM").otherwise("LOW")
    return agg.select("cluster_id", tier.alias("confidence"), F.when(tier == "UNVERIFIED", "low").otherwise(F.lower(tier)).alias("tier"))


def source_priority(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Highest priority of a cluster's sources as 0..1, and whether one is official."""
    return attach_source(members, sources).groupBy("cluster_id").agg((F.greatest(F.lit(0), F.least(F.lit(100), F.max("priority"))) / 100).alias("priority"), F.bool_or("official").alias("official"))


def duplicate_counts(duplicates: DataFrame, members: DataFrame) -> DataFrame:
    """Number of dropped duplicates (kept_id, item_id) per cluster."""
    per_item = duplicates.groupBy(F.col("kept_id").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    return members.join(per_item, "item_id").groupBy("cluster_id").agg(F.sum("n").alias("n_duplicates"))


def tight_spans(members: DataFrame, min_sources: int = vocab.BREAKING_SOURCES) -> DataFrame:
    """In minutes, the tightest span over min(min_sources, n) dated reports of a cluster, and over two."""
    w = Window.partitionBy("cluster_id").orderBy("at")
    dated = members.filter(F.col("published_at").isNotNull()).select("cluster_id", seconds(F.col("published_at")).alias("at"))
    dated = dated.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cluster_id")))
    steps = [F.lead("at", k - 1).over(w) - F.col("at") for k in range(2, min_sources + 1)]
    need = F.least(F.col("n"), F.lit(min_sources))
    span = F.coalesce(*[F.when(need == k, s) for k, s in zip(range(2, min_sources + 1), steps)])
    return dated.withColumn("span", span).withColumn("two", steps[0]).groupBy("cluster_id").agg((F.min("span") / 60).alias("span"), (F.min("two") / 60).alias("two"))


def breaking(members: DataFrame, sources: DataFrame, clusters: DataFrame, min_sources: int = vocab.BREAKING_SOURCES, minutes: float = vocab.BREAKING_MINUTES) -> DataFrame:
    """Breaking if enough publishers and a tight span; or two publishers, an official one, an urgent category and a tight pair."""
    agg = attach_source(members, sources).groupBy("cluster_id").agg(F.count_distinct(publisher_key(F.col("source_id"))).alias("p"), F.bool_or("official").alias("official"))
    joined = agg.join(tight_spans(members, min_sources), "cluster_id", "left").join(clusters.select("cluster_id", "category"), "cluster_id", "left")
    return joined.select("cluster_id", breaking_rule(min_sources, minutes).alias("breaking"))


def breaking_rule(min_sources: int, minutes: float) -> Column:
    many = (F.col("p") >= F.lit(max(2, min_sources))) & (F.col("span") <= minutes)
    urgent = (F.col("p") >= 2) & F.col("official") & F.col("category").isin(*vocab.URGENT_CATEGORIES) & (F.col("two") <= minutes)
    return F.coalesce(many, F.lit(False)) | F.coalesce(urgent, F.lit(False))


def freshness(newest: Column, now: Column, hours: float = vocab.FRESH_HOURS) -> Column:
    """From 1 down to 0 over `hours`; 0 without a date."""
    age = F.greatest(F.lit(0.0), (seconds(now) - seconds(newest)) / 3600)
    return F.coalesce(F.greatest(F.lit(0.0), 1 - age / hours), F.lit(0.0))


def locality(section: Column) -> Column:
    """R2."""
    scores = F.create_map(*[x for k, v in vocab.LOCALITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(scores[F.lower(section)], F.lit(0.2))


def corroboration(publishers: Column) -> Column:
    """0 for one publisher, 0.5 for two, 1 from three."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (publishers - 1) / 2))


def category_boost(category: Column, section: Column) -> Column:
    """Urgent categories count, most of all where they are local."""
    urgent = F.lower(category).isin(*vocab.URGENT_CATEGORIES)
    return F.when(urgent & (F.lower(section) == "local"), 1.0).when(urgent, 0.5).otherwise(0.0)


def stale_penalty(newest: Column, now: Column, per_day: float = vocab.STALE_PER_DAY, grace: float = vocab.STALE_GRACE_HOURS) -> Column:
    """Grows by the day after the grace hours, up to a bound."""
    age = (seconds(now) - seconds(newest)) / 3600
    return F.when(age > grace, F.least(F.lit(vocab.STALE_MOST), (age - grace) / 24 * per_day)).otherwise(0.0)


def score_clusters(members: DataFrame, sources: DataFrame, clusters: DataFrame, now: Column, duplicates: DataFrame | None = None, weights: dict[str, float] | None = None, min_sources: int = vocab.BREAKING_SOURCES, minutes: float = vocab.BREAKING_MINUTES) -> DataFrame:
    """Score of each cluster with its parts; duplicates has cluster_id and n_duplicates."""
    w = {**vocab.RANK_WEIGHTS, **(weights or {})}
    agg = attach_source(members, sources).groupBy("cluster_id").agg(F.count_distinct(publisher_key(F.col("source_id"))).alias("p"), F.bool_or("official").alias("official"), F.max("priority").alias("priority"), F.max("published_at").alias("newest"), F.min("published_at").alias("first_seen"), F.count(F.lit(1)).alias("n"))
    joined = agg.join(tight_spans(members, min_sources), "cluster_id", "left").join(clusters.select("cluster_id", "section", "category"), "cluster_id", "left")
    joined = joined.withColumn("section", F.coalesce("section", F.lit("world"))).withColumn("category", F.coalesce("category", F.lit(vocab.DEFAULT_CATEGORY)))
    joined = joined.join(duplicates, "cluster_id", "left") if duplicates is not None else joined.withColumn("n_duplicates", F.lit(0))
    repeats = F.coalesce("n_duplicates", F.lit(0))
    parts = joined.select(
        "cluster_id", "section", "category", "first_seen", F.col("p").alias("n_publishers"),
        freshness(F.col("newest"), now).alias("freshness"), locality(F.col("section")).alias("locality"), corroboration(F.col("p")).alias("corroboration"),
        (F.greatest(F.lit(0), F.least(F.lit(100), F.col("priority"))) / 100).alias("source_priority"), breaking_rule(min_sources, minutes).alias("breaking"),
        category_boost(F.col("category"), F.col("section")).alias("category_boost"), stale_penalty(F.col("newest"), now).alias("stale_penalty"),
        F.when(repeats > 0, vocab.DUPLICATE_PENALTY).when((F.col("n") > 1) & (F.col("p") == 1), vocab.DUPLICATE_PENALTY / 2).otherwise(0.0).alias("duplicate_penalty"),
    )
    total = sum((F.col(k).cast("double") * v for k, v in w.items()), F.lit(0.0)) - F.col("stale_penalty") - F.col("duplicate_penalty")
    return parts.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def order_clusters(scored: DataFrame) -> DataFrame:
    """The queue order: by score, first report and id; a range sort, no single task."""
    return scored.orderBy(F.desc("score"), "first_seen", "cluster_id")


def fingerprint(members: DataFrame, columns: tuple[str, ...] = ("item_id", "source_id", "url", "headline", "excerpt", "published_at")) -> DataFrame:
    """(cluster_id, fingerprint): a hash of what a cluster's members say that does not depend on their order.  Each
    member is hashed by itself, so only hashes meet."""
    line = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return members.groupBy("cluster_id").agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256), 1, 32).alias("fingerprint"))


def work_queue(scored: DataFrame, members: DataFrame, sources: DataFrame, stored: DataFrame, limit: int = 50) -> DataFrame:
    """The best `limit` clusters that want a brief, in queue order; the limit is the feature.

    Of scored clusters those of high or medium confidence with a member that may be used as text, which are new or updated,
    or have no stored brief that is complete and fits what the members say now.  stored: cluster_id, status and the
    brief_headline, brief_body, brief_fingerprint and fingerprint of the clusters; one that is not there is new.
    """
    usable = attach_source(members, sources).filter(F.col("source_rights").isin("PUBLIC_DOMAIN", "OPEN_LICENSE", "RSS_EXCERPT_ALLOWED", "METADATA_ONLY")).select("cluster_id").distinct()
    sure = confidence(members, sources).filter(F.col("confidence").isin("HIGH", "MEDIUM"))
    done = reusable_briefs(stored.filter(~F.coalesce(F.col("status"), F.lit("new")).isin("new", "updated"))).select("cluster_id")
    queue = scored.join(usable, "cluster_id", "left_semi").join(sure, "cluster_id", "left_semi").join(done, "cluster_id", "left_anti")
    return order_clusters(queue).limit(limit)
