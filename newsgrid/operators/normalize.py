"""Rights, item normalisation and rule checks of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid import vocab
from newsgrid.functions import text as x
from newsgrid.operators.rank import small

RIGHTS_FIELDS = ("excerpt_limit", "excerpt_allowed", "feeds_text", "image_reuse", "ingestible")


def rights_of(mode: Column) -> Column:
    """Struct of what a rights mode allows; an unknown mode allows nothing."""
    row = lambda values: F.struct(*[F.lit(v).alias(n) for n, v in zip(RIGHTS_FIELDS, values)])
    table = F.create_map(*[p for k, v in vocab.RIGHTS.items() for p in (F.lit(k), row(v))])
    return F.coalesce(table[mode], row(vocab.RIGHTS["BLOCKED"]))


def filter_sources(sources: DataFrame, features: dict[str, bool] | None = None) -> DataFrame:
    """IO2: enabled sources whose type is not switched off and whose rights are not BLOCKED."""
    off = [t for t, on in (features or {}).items() if not on]
    kept = sources.filter("enabled").filter(rights_of(F.col("rights_mode"))["ingestible"])
    return kept.filter(~F.col("type").isin(*off)) if off else kept


def normalize(raw: DataFrame, sources: DataFrame, now: Column, max_ahead_s: int = 3600) -> DataFrame:
    """Raw items (source_id, title, summary_html, url, published_at, ...) as news items.

    Without a URL or a title, with a URL that cannot be parsed, or dated over an hour ahead they are dropped; without a
    date they are dated now.  The excerpt is cut to what the source's rights allow.
    """
    dim = sources.select("source_id", F.col("name").alias("_name"), F.coalesce("rights_mode", F.lit("METADATA_ONLY")).alias("_mode"), F.col("language").alias("_language"))
    rows = raw.join(small(dim), "source_id", "left").withColumn("_mode", F.coalesce("_mode", F.lit("METADATA_ONLY")))
    headline = x.collapse(x.strip_replacement(F.col("title")))
    rows = rows.withColumn("_headline", headline).withColumn("_url", x.canonicalize_url(F.col("url"))).withColumn("_at", F.coalesce("published_at", now))
    rows = rows.filter((F.col("_headline") != "") & F.col("_url").isNotNull() & (F.trim("url") != "") & (F.unix_micros(F.col("_at").cast("timestamp")) <= F.unix_micros(now) + max_ahead_s * 1_000_000))
    limit = rights_of(F.col("_mode"))["excerpt_limit"]
    body = x.html_to_text(F.col("summary_html"))
    excerpt = F.when(limit > 0, F.nullif(F.when(F.length(body) > limit, F.regexp_replace(F.substring(body, F.lit(1), limit), r"\s+$", "")).otherwise(body), F.lit("")))
    language = F.coalesce(F.col("language") if "language" in raw.columns else F.lit(None), F.col("_language"), F.lit("en"))
    publisher = F.coalesce(F.nullif(F.col("publisher"), F.lit("")) if "publisher" in raw.columns else F.lit(None), F.col("_name"), F.lit(""))
    kept = [c for c in raw.columns if c not in {"title", "summary_html", "url", "published_at", "language", "publisher", "source_id"}]
    return rows.select(*kept, x.item_id(F.col("_url")).alias("id"), "source_id", publisher.alias("publisher"), F.substring("_headline", 1, 200).alias("headline"), excerpt.alias("excerpt"), F.col("_url").alias("url"), F.col("_at").alias("published_at"), language.alias("language"), F.col("_mode").alias("rights_mode"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that a row breaks; a rule is a condition that must hold, and null breaks it."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def check_registry(sources: DataFrame) -> DataFrame:
    """(source_id, problem): repeated ids, unknown rights modes, open licence without its name."""
    twice = sources.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("source_id", F.lit("duplicate id").alias("problem"))
    unknown = sources.filter(~F.coalesce(F.col("rights_mode").isin(*vocab.RIGHTS), F.lit(False))).select("source_id", F.lit("unknown rights mode").alias("problem"))
    unnamed = sources.filter((F.col("rights_mode") == "OPEN_LICENSE") & (F.coalesce("license", F.lit("")) == "")).select("source_id", F.lit("no license").alias("problem"))
    return twice.unionByName(unknown).unionByName(unnamed)


def build_queries(sources: DataFrame, states: DataFrame) -> DataFrame:
    """IO11: search terms of a source: six cities at most, its state's name, four counties at most, joined by OR.

    sources: source_id, cities, admin1, counties; states: admin1, state_name.
    """
    named = sources.join(small(states), "admin1", "left")
    quoted = lambda a: F.transform(a, lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    clean = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    terms = F.concat(quoted(F.slice(clean("cities"), 1, 6)), quoted(F.array_compact(F.array("state_name"))), quoted(F.slice(clean("counties"), 1, 4)))
    return named.select("source_id", F.array_join(F.array_distinct(terms), " OR ").alias("query"))
