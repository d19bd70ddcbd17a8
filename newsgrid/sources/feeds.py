"""Landed feed documents to raw items.

raw: source_id, type, body (string, or binary before decode_body), feed_url, http_charset.  Every parser returns
RAW_ITEM columns; a document that cannot be parsed gives no items and shows up in `parse_errors`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BODY_CAP = 2 * 1024 * 1024
SOURCE_SCHEMA = "id string, name string, homepage string, feedUrl string, apiUrl string, type string, coverage struct<country:string,admin1:string,admin1Name:string,admin2:array<string>,cities:array<string>,metro:string>, rightsMode string, license string, language string, enabled boolean, priority int, imageRules struct<allowReuse:boolean,requireAttribution:boolean>, notes string, lastVerified string"
STATUSES = ("new", "updated", "unchanged")
RAW_ITEM = ("source_id", "title", "url", "summary_html", "published_at", "publisher")


def read_sources(spark: SparkSession, folder: str, enabled_only: bool = True) -> DataFrame:
    """IO1: the registry, all JSON files under a folder but regions.json."""
    rows = spark.read.schema(SOURCE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(folder).withColumn("_file", F.input_file_name()).filter(~F.col("_file").endswith("/regions.json")).drop("_file")
    rows = rows.filter(F.col("id").isNotNull())
    return rows.filter(F.coalesce("enabled", F.lit(True))) if enabled_only else rows


def is_hostile(body: Column) -> Column:
    """IO5: entity or element declarations in the first 200,000 characters."""
    return F.upper(F.substring(F.coalesce(body, F.lit("")), 1, 200000)).rlike("<!(ENTITY|ELEMENT)")


def screen_raw(raw: DataFrame, cap: int = BODY_CAP) -> tuple[DataFrame, DataFrame]:
    """IO5, IO12: (accepted, rejected with a reason)."""
    reason = F.when(F.octet_length("body") > cap, "too long").when(is_hostile(F.col("body").cast("string")), "declarations").when(F.coalesce(F.length("body"), F.lit(0)) == 0, "empty")
    marked = raw.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def _decode(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    def text(body: bytes | None, charset: str | None) -> str | None:
        if body is None:
            return None
        declared = re.search(rb"""encoding=["']([A-Za-z0-9_.-]+)["']""", body[:200])
        for name in ("utf-8-sig", declared and declared[1].decode(), charset):
            try:
                if name:
                    named = "windows-1252" if name.lower() in ("iso-8859-1", "latin-1", "latin1") else name
                    return body.decode(named)
            except (LookupError, UnicodeDecodeError):
                continue
        return body.decode("windows-1252", errors="replace")

    return pd.Series([text(b, c) for b, c in zip(bodies, charsets)], dtype="object")


def decode_body(body: Column, http_charset: Column) -> Column:
    """IO6: bytes as text: UTF-8 if they are valid, else the declared charset, else the HTTP one, else windows-1252.

    Spark's own decode knows no one-byte code page but ISO 8859-1, so this is done in Arrow batches."""
    return F.pandas_udf(_decode, T.StringType())(body, http_charset)


def parse_time(text: Column) -> Column:
    """RFC 822 dates, ISO 8601 and yyyyMMddTHHmmssZ; null if none fits."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UT)$", "+0000")
    tries = [F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "yyyyMMdd'T'HHmmssX")]
    return F.coalesce(F.try_to_timestamp(F.trim(text)), *tries)


RSS = "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string, encoded: string>>>"
ATOM = "entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, summary: string, content: string, updated: string, published: string>>"


def _item(title: Column, url: Column, summary: Column, at: Column, publisher: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.trim(title).alias("title"), F.trim(url).alias("url"), summary.alias("summary_html"), at.alias("published_at"), (none if publisher is None else publisher).alias("publisher"))


def _items(parsed: Column, item: Callable[[Column], Column]) -> Column:
    """The items of a parsed document that have a title and a URL, as an array; null if it could not be parsed."""
    return F.filter(F.transform(parsed, item), lambda i: (F.coalesce(i["title"], F.lit("")) != "") & (F.coalesce(i["url"], F.lit("")) != ""))


def _rows(raw: DataFrame, items: Column) -> DataFrame:
    return raw.select("source_id", F.explode(items).alias("i")).select("source_id", "i.*")


def rss_items() -> Column:
    return _items(F.from_xml("body", RSS)["channel"]["item"], lambda i: _item(i["title"], i["link"], F.coalesce(i["description"], i["encoded"]), parse_time(i["pubDate"])))


def atom_items() -> Column:
    def link(i: Column) -> Column:
        return F.coalesce(F.get(F.filter(i["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get(i["link"], F.lit(0))["_href"])

    return _items(F.from_xml("body", ATOM)["entry"], lambda i: _item(i["title"], link(i), F.coalesce(i["summary"], i["content"]), parse_time(F.coalesce(i["updated"], i["published"]))))


GDELT = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>"
QUAKES = "features array<struct<properties:struct<mag:double,place:string,time:bigint,url:string,title:string>>>"
ALERTS = "features array<struct<id:string,properties:struct<`@id`:string,event:string,headline:string,description:string,instruction:string,sent:string,severity:string,expires:string>>>"


def gdelt_items() -> Column:
    def item(i: Column) -> Column:
        domain = F.coalesce(F.nullif(i["domain"], F.lit("")), F.try_parse_url(i["url"], F.lit("HOST")))
        return _item(i["title"], i["url"], F.lit(None).cast("string"), parse_time(i["seendate"]), domain)

    return _items(F.from_json("body", GDELT)["articles"], item)


def quake_items() -> Column:
    return _items(F.from_json("body", QUAKES)["features"]["properties"], lambda i: _item(i["title"], i["url"], i["place"], F.timestamp_millis(i["time"])))


def alert_items() -> Column:
    def item(i: Column) -> Column:
        p = lambda c: F.nullif(F.trim(i["properties"][c]), F.lit(""))
        return _item(F.coalesce(p("headline"), p("event")), F.coalesce(p("@id"), F.col("feed_url")), F.concat_ws("\n\n", p("description"), p("instruction")), parse_time(i["properties"]["sent"]))

    return _items(F.from_json("body", ALERTS)["features"], item)


def parse_rss(raw: DataFrame) -> DataFrame:
    """IO3."""
    return _rows(raw, rss_items())


def parse_atom(raw: DataFrame) -> DataFrame:
    """IO4: the alternate link, else the first."""
    return _rows(raw, atom_items())


def parse_gdelt(raw: DataFrame) -> DataFrame:
    """IO7: search results; the publisher is the domain, else the host of the URL."""
    return _rows(raw, gdelt_items())


def parse_quakes(raw: DataFrame) -> DataFrame:
    """IO8: times are milliseconds since 1970."""
    return _rows(raw, quake_items())


def parse_alerts(raw: DataFrame) -> DataFrame:
    """IO9: headline or else event; description and instruction; the alert's own address or else the feed's."""
    return _rows(raw, alert_items())


ITEMS = {"rss": rss_items, "atom": atom_items, "gdelt": gdelt_items, "json-api": quake_items, "nws-alerts": alert_items}


def items_by_type() -> Column:
    """The items of a document by its type, so that documents of all types are read once; null for an unknown type."""
    return reduce(lambda case, kind: case.when(F.col("type") == kind, ITEMS[kind]()), ITEMS, F)


def ingest(raw: DataFrame) -> DataFrame:
    """IO10, S5: items of all documents, each by its type; one bad document only loses its own items."""
    return _rows(screen_raw(raw)[0], items_by_type())


def parse_errors(raw: DataFrame) -> DataFrame:
    """IO10: a row for each document that gave no items, with the reason."""
    accepted, rejected = screen_raw(raw)
    silent = accepted.filter(F.coalesce(F.size(items_by_type()), F.lit(0)) <= 0).withColumn("reason", F.lit("no items"))
    return rejected.select("source_id", "type", "reason").unionByName(silent.select("source_id", "type", "reason"))


def build_gazetteer(lines: DataFrame, seed: DataFrame, most: int = 1000, least_population: int = 50000) -> DataFrame:
    """IO13: the largest cities of a tab-separated dump (column `value`) that the seed list (country, name) lacks."""
    c = F.split("value", "\t")
    cities = lines.filter(F.size(c) >= 15).select(c[1].alias("name"), c[8].alias("country"), c[14].try_cast("bigint").alias("population")).filter(F.col("population") >= least_population)
    fresh = cities.join(seed.select("country", "name"), ["country", "name"], "left_anti")
    return fresh.orderBy(F.desc("population"), "name", "country").limit(most)


LSAD_NAMES = ("city", "town", "village", "borough", "township")


def build_municipalities(lines: DataFrame, state: str, lsad: tuple[str, ...] = ("21", "25", "43", "44", "47")) -> DataFrame:
    """IO14: lower-case municipality names of one state from a tab-separated dump with a header row."""
    c = F.split("value", "\t")
    rows = lines.select(c[0].alias("state"), c[3].alias("name"), c[4].alias("lsad"), F.trim(c[5]).alias("status"))
    kept = rows.filter((F.col("state") == state) & F.col("status").isin("A", "S") & F.col("lsad").isin(*lsad))
    return kept.select(F.lower(F.trim(F.regexp_replace("name", rf"\s+({'|'.join(LSAD_NAMES)})$", ""))).alias("name")).distinct().orderBy("name")


def run_summary(raw: DataFrame, items: DataFrame, normalized: DataFrame, errors: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """IO18: counts of a run; failed: sources with a row in `errors`; new, updated and unchanged: clusters by status."""
    none = F.lit(0).cast("long")
    row = lambda df, name, n: df.agg(n.alias("n")).select(*[(F.col("n") if c == name else none).alias(c) for c in ("checked", "discovered", "normalised", "failed", *STATUSES)])
    parts = row(raw, "checked", F.count_distinct("source_id")).union(row(items, "discovered", F.count(F.lit(1)))).union(row(normalized, "normalised", F.count(F.lit(1))))
    if errors is not None:
        parts = parts.union(row(errors, "failed", F.count_distinct("source_id")))
    for status in STATUSES if clusters is not None else ():
        parts = parts.union(row(clusters, status, F.count_if(F.col("status") == status)))
    total = parts.agg(*[F.sum(c).alias(c) for c in parts.columns])
    return total.withColumn("dropped", F.col("discovered") - F.col("normalised"))


def shift_to_now(items: DataFrame, now: Column) -> DataFrame:
    """IO19: all dates moved by the same time, so that the newest item is one hour old."""
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    newest = items.agg(F.max(micros)).first()[0]
    return items.withColumn("published_at", F.timestamp_micros(micros - F.lit(newest) + F.unix_micros(now) - 3_600_000_000))


def write_stage(df: DataFrame, path: str, run_id: str) -> None:
    """IO15: a stage's table, a folder per run."""
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append").parquet(path)
