"""Rules of the published tables, for `normalize.violations`: a rule is a condition that must hold, and null breaks it.

sources: columns of feeds.SOURCE_SCHEMA.  stories: id, headline, dek, body, excerpt, category, version, tier, ai, ai_model,
published_at, generated_at, locations (country, admin1, lat, lon), sources (publisher, headline, url, rights_mode, excerpt).
editions: edition_id, kind, generated_at, country, label, sections (id, title, story_ids), story_ids.  index: id, path, kind,
country, label, updated_at, story_count.  slices (of places or postal codes): country, generated_at, n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsgrid import vocab

Rules = dict[str, Callable[[], Column]]


def optional(c: str, ok: Callable[[Column], Column]) -> Column:
    """A column that may be null."""
    return F.col(c).isNull() | ok(F.col(c))


def every(c: str, ok: Callable[[Column], Column]) -> Column:
    """An array of at least one element, all of which hold."""
    return (F.size(c) >= 1) & F.forall(c, lambda x: F.coalesce(ok(x), F.lit(False)))


def _at_most(c: str, n: int) -> Callable[[], Column]:
    return lambda: optional(c, lambda x: F.length(x) <= n)


def _uri(c: Column) -> Column:
    return c.rlike(vocab.URI)


def _place(x: Column) -> Column:
    lacks = lambda c, ok: x[c].isNull() | ok
    return x["country"].rlike(vocab.COUNTRY) & lacks("admin1", x["admin1"].rlike(vocab.ADMIN1)) & lacks("lat", x["lat"].between(-90, 90)) & lacks("lon", x["lon"].between(-180, 180))


def _cited(x: Column) -> Column:
    mode = x["rights_mode"].isNull() | x["rights_mode"].isin(*vocab.RIGHTS)
    return x["publisher"].isNotNull() & x["headline"].isNotNull() & _uri(x["url"]) & mode & (x["excerpt"].isNull() | (F.length(x["excerpt"]) <= 300))


SOURCES: Rules = {
    "id": lambda: F.length("id").between(2, 80) & F.col("id").rlike(vocab.SOURCE_ID),
    "name": lambda: F.length("name").between(2, 120),
    "homepage": lambda: _uri(F.col("homepage")),
    "address": lambda: _uri(F.coalesce("feedUrl", "apiUrl")),
    "type": lambda: F.col("type").isin(*vocab.SOURCE_TYPES),
    "country": lambda: F.col("coverage.country").rlike(vocab.COUNTRY),
    "admin1": lambda: optional("coverage.admin1", lambda x: x.rlike(vocab.ADMIN1)),
    "rights_mode": lambda: F.col("rightsMode").isin(*vocab.RIGHTS),
    "language": lambda: F.col("language").rlike(vocab.LANGUAGE),
    "enabled": lambda: F.col("enabled").isNotNull(),
    "priority": lambda: F.col("priority").between(0, 100),
    "license": lambda: (F.col("rightsMode") != "OPEN_LICENSE") | (F.length("license") >= 1),
    "last_verified": lambda: optional("lastVerified", lambda x: F.try_to_date(x, "yyyy-MM-dd").isNotNull()),
}
STORIES: Rules = {
    "id": lambda: F.length("id").between(8, 128),
    "headline": lambda: F.length("headline").between(8, 200),
    "dek": _at_most("dek", 300),
    "body": _at_most("body", 6000),
    "excerpt": _at_most("excerpt", 300),
    "category": lambda: F.col("category").isin(*vocab.TAXONOMY),
    "version": lambda: optional("version", lambda x: x >= 1),
    "tier": lambda: optional("tier", lambda x: x.isin("high", "medium", "low")),
    "times": lambda: F.col("published_at").isNotNull() & F.col("generated_at").isNotNull(),
    "ai": lambda: F.col("ai").isNotNull() & (~F.col("ai") | (F.col("ai_model").isNotNull() & F.col("body").isNotNull())),
    "locations": lambda: every("locations", _place),
    "sources": lambda: every("sources", _cited),
}
EDITIONS: Rules = {
    "edition_id": lambda: F.length("edition_id") >= 3,
    "kind": lambda: F.col("kind").isin(*vocab.EDITION_KINDS),
    "generated_at": lambda: F.col("generated_at").isNotNull(),
    "location": lambda: F.col("country").rlike(vocab.COUNTRY) & F.col("label").isNotNull(),
    "sections": lambda: F.forall("sections", lambda x: x["id"].isNotNull() & x["title"].isNotNull() & x["story_ids"].isNotNull()),
    "stories": lambda: F.col("story_ids").isNotNull(),
}
INDEX: Rules = {
    "id": lambda: F.col("id").isNotNull(),
    "path": lambda: F.col("path").rlike(vocab.FEED_PATH),
    "kind": lambda: optional("kind", lambda x: x.isin(*vocab.EDITION_KINDS)),
    "location": lambda: F.col("country").rlike(vocab.COUNTRY) & F.col("label").isNotNull(),
    "updated_at": lambda: F.col("updated_at").isNotNull(),
    "story_count": lambda: optional("story_count", lambda x: x >= 0),
}
SLICES: Rules = {
    "country": lambda: F.col("country").rlike(vocab.COUNTRY),
    "generated_at": lambda: F.col("generated_at").isNotNull(),
    "entries": lambda: F.col("n").isNotNull(),
}


def conditions(rules: Rules) -> dict[str, Column]:
    """The rules as columns, for `normalize.violations`."""
    return {name: rule() for name, rule in rules.items()}
