"""From ranked stories to feeds and editions.

stories: story_id, published_s (epoch seconds), breaking, score, section, category, country, admin1, city, metro.
A feed is a directory; feed rows are (dir, story_id, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid import vocab
from newsgrid.checkpoint import written
from newsgrid.operators.rank import small
from newsgrid.sources.documents import write_documents


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 become one hyphen, none at the ends; nothing left: unknown."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("unknown"))


def admin1_slug(code: Column) -> Column:
    """The part after the country of a code such as US-NY, as a slug."""
    return slug(F.regexp_replace(code, "^[^-]*-", ""))


def rank_order() -> list[Column]:
    """Breaking first, then by score, then the earlier moment, then the id."""
    return [F.desc("breaking"), F.desc(F.coalesce("score", F.lit(0.0))), F.asc_nulls_first("published_s"), F.asc("story_id")]


def attach_cluster(stories: DataFrame, clusters: DataFrame) -> DataFrame:
    """Section and score of a story from its cluster; without one, the section follows from the place."""
    known = F.lower("cluster_section").isin(*vocab.SECTIONS)
    joined = stories.join(clusters.select(F.col("cluster_id").alias("story_id"), F.col("section").alias("cluster_section"), F.col("score").alias("cluster_score")), "story_id", "left")
    return joined.withColumn("section", F.when(known, F.lower("cluster_section")).otherwise(section_of("country", "admin1", "admin2", "city", "metro"))).withColumn("score", F.coalesce("cluster_score", F.lit(0.0))).drop("cluster_section", "cluster_score")


def section_of(country: str, admin1: str, admin2: str, city: str, metro: str) -> Column:
    """The section of a place, by the most specific part that is there."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.when(there(city), "local").when(there(admin2) | there(metro), "regional").when(there(admin1), "state").when(F.upper(F.coalesce(F.col(country), F.lit("US"))) == "US", "national").otherwise("world")


def fan_out_feeds(stories: DataFrame) -> DataFrame:
    """A row per story and feed (city, metro, state, nation; world and city outside the US)."""
    return _fanned(stories.withColumn("feeds", _feeds()))


def _fanned(listed: DataFrame) -> DataFrame:
    return listed.withColumn("feed", F.explode("feeds")).select(*[c for c in listed.columns if c != "feeds"], "feed.dir", "feed.tier")


def _feeds() -> Column:
    """The feeds of a story: structs of directory and tier."""
    country = F.lower(F.coalesce("country", F.lit("US")))
    us, base = country == "us", F.concat(F.lit("feeds/"), country, F.lit("/"), admin1_slug(F.col("admin1")), F.lit("/"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""

    def feed(when: Column, path: Column, tier: str) -> Column:
        return F.when(when, F.struct(path.alias("dir"), F.lit(tier).alias("tier")))

    feeds = F.array(
        feed(has("city") & has("admin1"), F.concat(base, slug(F.col("city")), F.lit("/")), "city"),
        feed(us & has("metro") & has("admin1"), F.concat(base, F.lit("regions/"), F.lower("metro"), F.lit("/")), "metro"),
        feed(us & has("admin1"), F.concat(base, F.lit("state/")), "state"),
        feed(us, F.concat(F.lit("feeds/"), country, F.lit("/national/")), "national"),
        feed(~us, F.lit("feeds/world/"), "world"),
    )
    return F.array_compact(feeds)


def cap_stories(fanned: DataFrame, caps: dict[str, int] | None = None, most: int = vocab.EDITION_MAX) -> DataFrame:
    """Per feed the best of each section up to its cap, then the best up to `most`; place is the rank from 1.

    Both limits are row numbers under a bound, which Spark applies before the shuffle as well, so a feed with very many
    stories sends few of them.
    """
    limits = F.create_map(*[x for k, v in {**vocab.SECTION_CAPS, **(caps or {})}.items() for x in (F.lit(k), F.lit(v))])
    best = max({**vocab.SECTION_CAPS, **(caps or {})}.values())
    in_section = F.row_number().over(Window.partitionBy("dir", "section").orderBy(*rank_order()))
    kept = fanned.withColumn("n", in_section).filter(F.col("n") <= best).filter(F.col("n") <= limits[F.col("section")])
    place = F.row_number().over(Window.partitionBy("dir").orderBy(*rank_order()))
    return kept.withColumn("place", place).filter(F.col("place") <= most).drop("n")


def feed_heads(fanned: DataFrame) -> DataFrame:
    """One row per feed with the place of its first story (by id)."""
    head = F.min_by(F.struct("country", "admin1", "city", "metro"), "story_id")
    return fanned.groupBy("dir", "tier").agg(head.alias("h"), F.count(F.lit(1)).alias("n_stories")).select("dir", "tier", "h.*", "n_stories")


def feed_donors(fanned: DataFrame) -> DataFrame:
    """(dir, donor, step): wider feeds that may fill a feed, nearest first.

    A city's metro feed is that of its first story; if that names none, the metro feed of the same state that shares
    most stories with the city (ties: the feed whose directory sorts first).
    """
    # a row for each feed, read four times
    heads = written(feed_heads(fanned))
    country = F.lower(F.coalesce("country", F.lit("US")))
    base = F.concat(F.lit("feeds/"), country, F.lit("/"), admin1_slug(F.col("admin1")), F.lit("/"))
    there = heads.select(F.col("dir").alias("donor"))
    own_metro = F.when((F.col("tier") == "city") & (country == "us") & (F.coalesce("metro", F.lit("")) != ""), F.concat(base, F.lit("regions/"), F.lower("metro"), F.lit("/")))
    wide = F.array_compact(F.array(
        F.when(own_metro.isNotNull(), F.struct(F.lit(1).alias("step"), own_metro.alias("donor"))),
        F.when((country == "us") & F.col("tier").isin("city", "metro"), F.struct(F.lit(2).alias("step"), F.concat(base, F.lit("state/")).alias("donor"))),
        F.when((country == "us") & F.col("tier").isin("city", "metro", "state"), F.struct(F.lit(3).alias("step"), F.concat(F.lit("feeds/"), country, F.lit("/national/")).alias("donor"))),
        F.when((country != "us") & (F.col("tier") == "city"), F.struct(F.lit(4).alias("step"), F.lit("feeds/world/").alias("donor"))),
    ))
    named = heads.select("dir", F.explode(wide).alias("w")).select("dir", "w.step", "w.donor").join(there, "donor", "left_semi")
    lost = heads.filter((F.col("tier") == "city") & (country == "us")).join(named.filter("step = 1").select("dir"), "dir", "left_anti").select("dir")
    if lost.isEmpty():
        # no feed asks for the stories that it shares with others
        return named.select("dir", "step", "donor")
    mine = fanned.filter("tier = 'city'").select("dir", "story_id", "admin1").join(lost, "dir", "left_semi").distinct()
    metros = fanned.filter("tier = 'metro'").select(F.col("dir").alias("donor"), "story_id", "admin1").distinct()
    shared = mine.join(metros, ["story_id", "admin1"]).groupBy("dir", "donor").agg(F.count(F.lit(1)).alias("n"))
    found = shared.groupBy("dir").agg(F.min_by("donor", F.struct(-F.col("n"), F.col("donor"))).alias("donor")).select("dir", F.lit(1).alias("step"), "donor")
    return named.select("dir", "step", "donor").unionByName(found)


def backfill(capped: DataFrame, donors: DataFrame, most: int = vocab.EDITION_MAX) -> DataFrame:
    """Each feed's own stories, then those of its donors in order, each story once, `most` at most; place from 1."""
    own = capped.select("dir", "story_id", F.lit(0).alias("step"), F.col("place").alias("at"))
    lent = donors.join(capped.select(F.col("dir").alias("donor"), "story_id", F.col("place").alias("at")), "donor").select("dir", "story_id", "step", "at")
    first = own.unionByName(lent).groupBy("dir", "story_id").agg(F.min(F.struct("step", "at")).alias("from"))
    place = F.row_number().over(Window.partitionBy("dir").orderBy("from"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("dir", "story_id", F.col("from.step").alias("step"), "place")


def build_feeds(stories: DataFrame, caps: dict[str, int] | None = None, most: int = vocab.EDITION_MAX) -> DataFrame:
    """Fan out, cap, fill up."""
    # directories are made of places by patterns, once, in tasks of even size, and read four times
    fanned = _fanned(written(stories.repartition("story_id").withColumn("feeds", _feeds())))
    # at most `most` rows for each feed, read for the feed itself and for those that it fills, and once more by most users
    capped = written(cap_stories(fanned, caps, most).select("dir", "story_id", "place"))
    return written(backfill(capped, feed_donors(fanned), most))


def feed_index(feeds: DataFrame, stories: DataFrame) -> DataFrame:
    """Stories and last update of each feed."""
    return stories.select("story_id", "published_s").join(small(feeds), "story_id").groupBy("dir").agg(F.count(F.lit(1)).alias("n_stories"), F.max("published_s").alias("updated_s"))


def slot_of_hour(hour: Column) -> Column:
    """The edition of an hour, null at night."""
    return F.when(hour.between(3, 9), "morning").when(hour.between(10, 15), "afternoon").when(hour.between(16, 21), "evening")


def edition_slot(moment: Column, zone: Column) -> Column:
    """R16 at a place: the zone's own hour (null zone: UTC)."""
    return slot_of_hour(F.hour(F.from_utc_timestamp(moment, F.coalesce(zone, F.lit("UTC")))))


def feed_timezone(feeds: DataFrame, cities: DataFrame, metros: DataFrame, admins: DataFrame) -> DataFrame:
    """Zone of a feed's city, else metro, else state, else the country's default; lookups have (key, zone)."""
    out = feeds
    for name, table in (("city", cities), ("metro", metros), ("admin1", admins)):
        dim = table.groupBy(F.lower("key").alias(f"_{name}")).agg(F.min("zone").alias(f"_{name}_zone"))
        out = out.join(dim, F.lower(F.col(name)) == F.col(f"_{name}"), "left").drop(f"_{name}")
    default = F.when(F.upper(F.coalesce("country", F.lit("US"))) == "US", "America/New_York").otherwise("UTC")
    return out.withColumn("zone", F.coalesce("_city_zone", "_metro_zone", "_admin1_zone", default)).drop("_city_zone", "_metro_zone", "_admin1_zone")


def edition_rows(feeds: DataFrame, stories: DataFrame, slot: Column) -> DataFrame:
    """A row per feed, kind (latest, the slot's, breaking) and story; breaking editions hold breaking stories only."""
    known = stories.select("story_id", "section", "breaking").join(small(feeds), "story_id")
    kinds = F.array_compact(F.array(F.lit("latest"), slot, F.when(F.col("breaking"), F.lit("breaking"))))
    return known.withColumn("kind", F.explode(kinds)).select("dir", "kind", "story_id", "section", "place")


def editions(rows: DataFrame) -> DataFrame:
    """One row per edition with its story ids in order and its sections; an edition holds EDITION_MAX stories at most."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "story_id", "section")))
    return rows.groupBy("dir", "kind").agg(ordered.alias("o")).select("dir", "kind", F.transform("o", lambda x: x["story_id"]).alias("story_ids"), F.array_sort(F.array_distinct(F.transform("o", lambda x: x["section"]))).alias("sections"), F.size("o").alias("story_count"))


def edition_index(docs: DataFrame) -> DataFrame:
    """IO16: (dir, kind, path, story_count) of each edition."""
    return docs.select("dir", "kind", F.concat("dir", "kind", F.lit(".json")).alias("path"), F.col("story_count").cast("long").alias("story_count"))


def write_editions(docs: DataFrame, path: str) -> None:
    """IO16: a JSON document for each edition at the path that the index has for it, below editions/, and when all are there,
    the index as JSON lines under index/."""
    docs = written(docs)
    body = F.to_json(F.struct("dir", "kind", "story_ids", "sections", "story_count"))
    write_documents(docs.select(F.concat("dir", "kind", F.lit(".json")).alias("path"), F.lit(0).alias("line"), body.alias("value")), f"{path}/editions")
    edition_index(docs).write.mode("overwrite").json(f"{path}/index")


def write_stories(stories: DataFrame, path: str, buckets: int = 256) -> None:
    """IO16: story documents as JSON lines, in folders by a hash of story_id, so that one is found without reading all."""
    stories.select(F.pmod(F.xxhash64("story_id"), F.lit(buckets)).alias("bucket"), F.to_json(F.struct(*stories.columns)).alias("value")).repartition("bucket").write.partitionBy("bucket").text(path)


def retain_shares(current: DataFrame, previous: DataFrame, now_s: int, days: int = 30) -> DataFrame:
    """Current shares and the previous ones younger than `days` that are not there any more."""
    young = previous.filter(F.col("shared_s") >= now_s - days * 86400).join(current.select("story_id"), "story_id", "left_anti")
    return current.unionByName(young)


def story_counters(stories: DataFrame) -> DataFrame:
    """Counts of stories by origin."""
    return stories.agg(F.count(F.lit(1)).alias("n"), F.count_if("ai").alias("ai"), F.count_if(~F.col("ai")).alias("cards"), F.count_if("has_image").alias("with_image"), F.count_if("downgraded").alias("downgraded"))


def write_location_slices(places: DataFrame, path: str, postal: DataFrame | None = None, default: str = "us") -> None:
    """IO17: for each lower-case country a document of its places, <country>.json, and of its postal codes,
    <country>-postal.json: a line with the country and the kind, then a line for each place or code.  A null country is the
    default one, which is always there."""
    spark = places.sparkSession

    def lines(rows: DataFrame, tail: str, kind: str) -> DataFrame:
        country = F.lower(F.coalesce("country", F.lit(default)))
        each = rows.select(country.alias("c"), F.lit(1).alias("k"), F.to_json(F.struct(*rows.columns)).alias("value"))
        base = spark.createDataFrame([(default,)], "c string").union(each.select("c")).distinct()
        heads = base.select("c", F.lit(0).alias("k"), F.to_json(F.struct(F.upper("c").alias("country"), F.lit(kind).alias("kind"))).alias("value"))
        return heads.unionByName(each).select(F.concat("c", F.lit(f"{tail}.json")).alias("path"), F.struct("k", "value").alias("line"), "value")

    every = lines(places, "", "places")
    if postal is None:
        postal = spark.createDataFrame([], "country string, postal string")
    write_documents(every.unionByName(lines(postal, "-postal", "postal")), path)


def location_slices(places: DataFrame, default: str = "us") -> DataFrame:
    """IO17: place counts and names by lower-case country; the default country is always there."""
    found = places.groupBy(F.lower("country").alias("country")).agg(F.count(F.lit(1)).alias("n_places"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))
    base = places.sparkSession.createDataFrame([(default,)], "country string")
    return found.select("country").union(base).distinct().join(found, "country", "left").withColumn("n_places", F.coalesce("n_places", F.lit(0).cast("long")))
