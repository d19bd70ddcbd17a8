"""Reader-side queries: search, saved stories, retention, notifications, upserts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.checkpoint import checkpointed
from newsgrid.operators.publish import admin1_slug, slug
from newsgrid.operators.rank import small


def search_index(stories: DataFrame, *fields: str) -> DataFrame:
    """The inverted index (term, story_id): lower-case words of letters and digits, each once per story."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *fields)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return stories.select(F.explode(F.array_distinct(words)).alias("term"), "story_id")


def search_terms(text: str, most: int = 8) -> list[str]:
    import re

    return [t.lower() for t in re.findall(r"[^\W_]+", text)][:most]


def search(index: DataFrame, stories: DataFrame, text: str, category: str = "", links: DataFrame | None = None, location: str = "", limit: int = 100) -> DataFrame:
    """Stories with a word that starts with each term, newest first; index: story_id, term; links: story_id, location_id."""
    terms = search_terms(text)
    if not terms:
        return stories.limit(0)
    hit = F.array(*[F.when(F.col("term").startswith(t), F.lit(t)) for t in terms])
    found = index.filter(reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in terms])).select("story_id", F.explode(F.array_compact(hit)).alias("hit"))
    return _chosen(found, len(set(terms)), stories, category, links, location, limit)


def _chosen(found: DataFrame, n: int, stories: DataFrame, category: str, links: DataFrame | None, location: str, limit: int) -> DataFrame:
    """Stories that all n terms hit; found: story_id, hit."""
    full = found.groupBy("story_id").agg(F.count_distinct("hit").alias("n")).filter(F.col("n") == n)
    out = stories.join(full, "story_id", "left_semi")
    if category:
        out = out.filter(F.col("category") == category)
    if location and links is not None:
        out = out.join(links.filter(F.col("location_id") == location), "story_id", "left_semi")
    return out.orderBy(F.desc("published_s"), "story_id").limit(limit)


#: Story numbers in a block of a posting list, and ranges of terms in a written index, about.
POSTINGS, RANGES = 1 << 16, 64


def write_search_index(index: DataFrame, path: str, ranges: int = RANGES) -> None:
    """An index (story_id, term) as posting lists, the terms sorted and cut into ranges, a folder for each, and under
    dictionary/ the first and last term of each range.

    A list is cut into blocks of POSTINGS story numbers, so a term of very many stories is many rows; a block holds its first
    number and the steps from each to the next.
    """
    block = F.floor(F.col("story_id") / POSTINGS)
    lists = index.select("term", F.col("story_id").cast("long").alias("story_id")).distinct().groupBy("term", block.alias("block")).agg(F.sort_array(F.collect_list("story_id")).alias("ids"))
    steps = F.zip_with(F.slice("ids", 2, F.size("ids")), "ids", lambda b, a: (b - a).cast("int"))
    coded = lists.select("term", F.element_at("ids", 1).alias("first"), F.slice(steps, 1, F.size("ids") - 1).alias("steps"))
    ordered = coded.repartitionByRange(ranges, "term").sortWithinPartitions("term", "first").withColumn("range", F.spark_partition_id())
    ordered.write.partitionBy("range").parquet(f"{path}/postings")
    written = index.sparkSession.read.parquet(f"{path}/postings")
    written.groupBy("range").agg(F.min("term").alias("low"), F.max("term").alias("high")).coalesce(1).write.parquet(f"{path}/dictionary")


def _numbers(first: pd.Series, steps: pd.Series) -> pd.Series:
    return pd.Series([np.cumsum([a, *s]) for a, s in zip(first, steps)])


def postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(story_id, hit) of a written index: the stories with a word that starts with each term; only the ranges that can hold
    such words are read."""
    # a row for each range; what starts with t lies between t and the last string that does
    ranges = spark.read.parquet(f"{path}/dictionary").collect()
    wanted = [r["range"] for r in ranges if any(r["low"][: len(t)] <= t <= r["high"] or r["low"].startswith(t) for t in terms)]
    if not wanted:
        return spark.createDataFrame([], "story_id long, hit string")
    rows = spark.read.schema("term string, first long, steps array<int>").parquet(*[f"{path}/postings/range={k}" for k in wanted])
    rows = rows.filter(reduce(lambda a, b: a | b, [F.col("term").startswith(t) for t in terms]))
    hit = F.array_compact(F.array(*[F.when(F.col("term").startswith(t), F.lit(t)) for t in terms]))
    each = rows.select(hit.alias("hits"), F.explode(F.pandas_udf(_numbers, "array<long>")(F.col("first"), F.col("steps"))).alias("story_id"))
    return each.select("story_id", F.explode("hits").alias("hit"))


def search_written(path: str, stories: DataFrame, text: str, category: str = "", links: DataFrame | None = None, location: str = "", limit: int = 100) -> DataFrame:
    """J16 over a written index; see search."""
    terms = search_terms(text)
    if not terms:
        return stories.limit(0)
    return _chosen(postings(stories.sparkSession, path, terms), len(set(terms)), stories, category, links, location, limit)


def saved_stories(saved: DataFrame, stories: DataFrame) -> DataFrame:
    """Saved stories, the last saved first."""
    return saved.join(stories, "story_id").orderBy(F.desc("saved_s"), "story_id")


def expire(stories: DataFrame, saved: DataFrame, links: DataFrame, before_s: int) -> DataFrame:
    """Stories that stay: not older than the bound, or saved, or in an edition."""
    old = stories.filter(F.col("published_s") < before_s)
    gone = old.join(saved.select("story_id"), "story_id", "left_anti").join(links.select("story_id"), "story_id", "left_anti")
    return stories.join(gone.select("story_id"), "story_id", "left_anti")


def orphans(children: DataFrame, stories: DataFrame) -> DataFrame:
    """Rows of a child table whose story is gone."""
    return children.join(stories.select("story_id"), "story_id", "left_anti")


def retention(editions: DataFrame, stories: DataFrame, alerts: DataFrame, now_s: int) -> dict[str, DataFrame]:
    """Editions of 3 days, stories of 7, alert marks of 30."""
    keep = lambda t, c, days: t.filter(F.col(c) >= now_s - days * 86400)
    return {"editions": keep(editions, "fetched_s", 3), "stories": keep(stories, "published_s", 7), "alerts": keep(alerts, "notified_s", 30)}


def lookup_translation(stories: DataFrame, cache: DataFrame, language: str) -> DataFrame:
    """Stories with their cached text; stale if it was made for another version."""
    c = cache.filter(F.col("lang") == language).groupBy("story_id").agg(F.max_by(F.struct("version", "text"), "version").alias("c"))
    return stories.join(c, "story_id", "left").withColumn("translation", F.when(F.col("c.version") == F.col("version"), F.col("c.text"))).withColumn("stale", F.coalesce(F.col("c.version") != F.col("version"), F.lit(False))).drop("c")


def rerank_interests(stories: DataFrame, interests: list[str]) -> DataFrame:
    """T5: stories of the chosen categories first, else in their places."""
    return stories.withColumn("chosen", F.col("category").isin(*interests) if interests else F.lit(False)).orderBy("dir", F.desc("chosen"), "place")


def pick_places(places: DataFrame, kind: str, parent: str | None = None, text: str = "") -> DataFrame:
    """Places of a type, under a parent, whose name or alias holds a text, by name."""
    out = places.filter(F.col("type") == kind)
    if parent is not None:
        out = out.filter(F.col("parent") == parent)
    if text:
        needle = text.lower()
        out = out.filter(F.lower("name").contains(needle) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(needle)))
    return out.orderBy("name")


def saved_places(places: DataFrame) -> DataFrame:
    """T7."""
    return places.orderBy("sort_order", "label")


def set_home(places: DataFrame, place_id: int) -> DataFrame:
    """Exactly this place is home."""
    return places.withColumn("is_home", F.col("place_id") == place_id)


def upsert(base: DataFrame, rows: DataFrame, keys: list[str], mode: str = "replace", order: str | None = None) -> DataFrame:
    """Replace: new rows win; ignore: rows with a known key are dropped.

    A key has one row afterwards: of several new ones the last by `order` (ignore: the first), then the one with the
    largest (ignore: smallest) other columns, which must be comparable.
    """
    others = [c for c in rows.columns if c not in keys]
    by, rest = F.col(order) if order else F.lit(0), F.struct(*others) if others else F.lit(0)
    one = (F.min if mode == "ignore" else F.max)(F.struct(by.alias("by"), rest.alias("rest")))
    once = rows.groupBy(*keys).agg(one.alias("_one")).select(*keys, *[F.col("_one")["rest"][c].alias(c) for c in others])
    if mode == "ignore":
        return base.unionByName(once.join(base.select(*keys), keys, "left_anti"))
    return base.join(once.select(*keys), keys, "left_anti").unionByName(once)


def replace_edition(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """S3: links without the editions that come anew, and the new ones."""
    return links.join(fresh.select("edition_id").distinct(), "edition_id", "left_anti").unionByName(fresh)


def edition_changes(log: DataFrame) -> DataFrame:
    """Log entries (location_id, at_s, edition_id) whose edition differs from the one before; the first is no change."""
    before = F.lag("edition_id").over(Window.partitionBy("location_id").orderBy("at_s", "edition_id"))
    return log.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") != F.col("edition_id"))).drop("before")


def in_quiet_hours(hour, start, end):
    """Hours from start up to end, over midnight if start is later; equal: none."""
    return F.when(start == end, False).when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def breaking_picks(stories: DataFrame, users: DataFrame, known: DataFrame, quota: int = 3) -> DataFrame:
    """For each reader the first breaking stories of their feed that they do not know, within interests and the day's
    quota, outside quiet hours.  stories: dir, story_id, category, breaking, place; users: user_id, dir, interests, sent,
    hour, quiet_start, quiet_end; known: user_id, story_id."""
    awake = users.filter(~in_quiet_hours(F.col("hour"), F.col("quiet_start"), F.col("quiet_end")))
    # breaking stories are few: readers of the same feed need not meet in one task
    fit = awake.join(small(checkpointed(stories.filter("breaking").select("dir", "story_id", "category", "place"))), "dir").filter((F.size("interests") == 0) | F.array_contains("interests", F.col("category")))
    fit = fit.join(known, ["user_id", "story_id"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("place", "story_id"))
    return fit.withColumn("turn", turn).filter(F.col("turn") <= quota).filter(F.col("turn") <= quota - F.col("sent")).select("user_id", "story_id", "turn")


def resolve_edition(places: DataFrame, index: DataFrame, kind: str = "latest") -> DataFrame:
    """(place_id, path): the first feed of a place's ladder that the index has; a slot falls back to the latest.

    places: place_id, country, admin1, city, metro; index: path."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    land = F.lower("country")
    us, base = F.upper("country") == "US", F.concat(F.lit("feeds/"), land, F.lit("/"), admin1_slug(F.col("admin1")), F.lit("/"))

    def ladder(k: str):
        path = lambda when, p: F.when(when, F.concat(p, F.lit(f"{k}.json")))
        return [path(has("city") & has("admin1"), F.concat(base, slug(F.col("city")), F.lit("/"))), path(us & has("metro") & has("admin1"), F.concat(base, F.lit("regions/"), F.lower("metro"), F.lit("/"))), path(us & has("admin1"), F.concat(base, F.lit("state/"))), path(us, F.concat(F.lit("feeds/"), land, F.lit("/national/"))), path(~us, F.lit("feeds/world/"))]

    steps = F.array_compact(F.array(*ladder(kind), *(ladder("latest") if kind != "latest" else [])))
    tried = places.select("place_id", F.posexplode(steps).alias("step", "path"))
    return tried.join(index.select("path").distinct(), "path").groupBy("place_id").agg(F.min_by("path", "step").alias("path"))


def fetch_state(log: DataFrame) -> DataFrame:
    """The last etag, date, final URL and permanent redirect of each source from a fetch log."""
    last = F.max_by(F.struct("etag", "last_modified", "final_url", "permanent"), "at_s")
    return log.groupBy("source_id").agg(last.alias("s"), F.max("at_s").alias("at_s")).select("source_id", "s.*", "at_s")


def source_health(items: DataFrame, log: DataFrame, sources: DataFrame, now_s: int, stale_days: int = 7) -> DataFrame:
    """(source_id, n_items, newest_s, issues) of every source: empty, no-dates, stale, redirected."""
    seen = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"), F.max("published_s").alias("newest_s"))
    moved = log.filter("permanent").select("source_id").distinct().withColumn("moved", F.lit(True))
    every = sources.select("source_id").join(seen, "source_id", "left").join(moved, "source_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    issues = F.array_compact(F.array(F.when(F.col("n_items") == 0, F.lit("empty")), F.when((F.col("n_items") > 0) & F.col("newest_s").isNull(), F.lit("no-dates")), F.when(F.col("newest_s") < now_s - stale_days * 86400, F.lit("stale")), F.when(F.coalesce("moved", F.lit(False)), F.lit("redirected"))))
    return every.select("source_id", "n_items", "newest_s", issues.alias("issues"))


def pick_image(stories: DataFrame, supplied: DataFrame, candidates: DataFrame) -> DataFrame:
    """(story_id, url, origin): a source's own image if its rights and its rules allow reuse and it is https, else the
    first candidate, in order of query and result, whose licence is allowed and whose title has the query's words.

    supplied: story_id, url, rights_mode, allow_reuse; candidates: story_id, query, query_no, result_no, title, url, license.
    """
    from newsgrid.functions.text import is_allowed_license, title_matches
    from newsgrid.operators.normalize import rights_of

    own = supplied.filter(rights_of(F.col("rights_mode"))["image_reuse"] & F.col("allow_reuse") & F.col("url").startswith("https://")).groupBy("story_id").agg(F.min("url").alias("own"))
    good = candidates.filter(is_allowed_license(F.col("license")) & F.col("url").startswith("https://") & title_matches(F.col("title"), F.col("query")))
    best = good.groupBy("story_id").agg(F.min_by("url", F.struct("query_no", "result_no")).alias("found"))
    joined = stories.select("story_id").join(own, "story_id", "left").join(best, "story_id", "left")
    return joined.select("story_id", F.coalesce("own", "found").alias("url"), F.when(F.col("own").isNotNull(), "source").when(F.col("found").isNotNull(), "search").alias("origin"))


IMAGES = "query struct<pages:map<string,struct<title:string,imageinfo:array<struct<url:string,descriptionurl:string,extmetadata:map<string,struct<value:string>>>>>>>"


def parse_image_candidates(raw: DataFrame, host: str = "https://upload.") -> DataFrame:
    """(story_id, title, url, license, creator, source_url) of image search answers that are allowed and on the host."""
    from newsgrid.functions.text import html_to_text, is_allowed_license

    p = raw.select("story_id", F.explode(F.map_values(F.from_json("body", IMAGES)["query"]["pages"])).alias("p")).select("story_id", "p.title", F.explode("p.imageinfo").alias("i"))
    meta = lambda k: F.col("i.extmetadata")[k]["value"]
    title = F.regexp_replace(F.regexp_replace("title", "^File:", ""), r"\.[A-Za-z]{3,4}$", "")
    out = p.select("story_id", title.alias("title"), F.col("i.url").alias("url"), meta("LicenseShortName").alias("license"), html_to_text(meta("Artist")).alias("creator"), F.col("i.descriptionurl").alias("source_url"))
    return out.filter(F.col("url").startswith(host) & is_allowed_license(F.col("license")))
