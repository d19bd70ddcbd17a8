"""Queries of the rules of published tables; the expressions of the rows hold in Spark and in DuckDB."""

from __future__ import annotations

from newsgrid.operators import rules
from newsgrid.operators.normalize import violations
from newsgrid.plans.registry import query
from newsgrid.plans.views import table

TIMES = "timestamp '2024-01-01 00:00:00'"


def register(name: str, of: str, key: str, columns: dict[str, str], checks: rules.Rules, broken: dict[str, str]) -> None:
    """A query of the rows of table `of` seen as `columns`, and SQL with the condition under which each rule is broken."""
    cases = ", ".join(f"CASE WHEN {when} THEN '{rule}' END" for rule, when in broken.items())

    @query(name, f"SELECT {key} AS key, rule FROM (SELECT {key}, unnest([{cases}]) AS rule FROM {of}) WHERE rule IS NOT NULL")
    def run(spark, d):
        rows = table(spark, d, of).selectExpr(f"{key} AS key", *[f"{e} AS {c}" for c, e in columns.items()])
        return violations(rows, "key", rules.conditions(checks))


register(
    "check_sources", "supplier", "s_suppkey",
    {
        "id": "CASE s_suppkey % 4 WHEN 0 THEN 'a--b' WHEN 1 THEN 'A' ELSE concat('s-', s_suppkey) END", "name": "CASE WHEN s_suppkey % 5 > 0 THEN s_name END", "homepage": "CASE WHEN s_suppkey % 6 > 0 THEN 'https://a.example' ELSE 'a example' END",
        "feedUrl": "CASE WHEN s_suppkey % 7 > 1 THEN 'https://a.example/f' END", "apiUrl": "CASE WHEN s_suppkey % 7 = 0 THEN 'https://a.example/q' END", "type": "CASE WHEN s_suppkey % 8 > 0 THEN 'rss' ELSE 'html' END",
        "coverage": "named_struct('country', CASE WHEN s_nationkey % 3 > 0 THEN 'US' ELSE 'us' END, 'admin1', CASE s_suppkey % 9 WHEN 0 THEN 'US-LONG' WHEN 1 THEN NULL ELSE 'US-NY' END)",
        "rightsMode": "CASE s_suppkey % 10 WHEN 0 THEN 'OTHER' WHEN 1 THEN 'OPEN_LICENSE' WHEN 2 THEN 'OPEN_LICENSE' WHEN 3 THEN NULL ELSE 'LINK_ONLY' END", "license": "CASE WHEN s_suppkey % 10 = 1 THEN 'CC-BY' END",
        "language": "CASE s_suppkey % 11 WHEN 0 THEN 'EN' WHEN 1 THEN 'en-US' ELSE 'en' END", "enabled": "CASE WHEN s_suppkey % 12 > 0 THEN true END", "priority": "s_suppkey % 113", "lastVerified": "CASE s_suppkey % 13 WHEN 0 THEN '2024-02-30' WHEN 1 THEN NULL ELSE '2024-02-29' END",
    },
    rules.SOURCES,
    {
        "id": "s_suppkey % 4 < 2", "name": "s_suppkey % 5 = 0", "homepage": "s_suppkey % 6 = 0", "address": "s_suppkey % 7 = 1", "type": "s_suppkey % 8 = 0", "country": "s_nationkey % 3 = 0", "admin1": "s_suppkey % 9 = 0",
        "rights_mode": "s_suppkey % 10 IN (0, 3)", "language": "s_suppkey % 11 = 0", "enabled": "s_suppkey % 12 = 0", "priority": "s_suppkey % 113 > 100", "license": "s_suppkey % 10 IN (2, 3)", "last_verified": "s_suppkey % 13 = 0",
    },
)
register(
    "check_stories", "documents", "doc_id",
    {
        "id": "CASE WHEN doc_id % 4 > 0 THEN concat('story-00', doc_id) ELSE 'short' END", "headline": "substr(text, 1, cast(doc_id % 230 AS int))", "dek": "substr(text, 1, cast(doc_id % 350 AS int))", "body": "text", "excerpt": "substr(text, 1, cast(doc_id % 330 AS int))",
        "category": "CASE WHEN lang = 'en' THEN 'local' ELSE lang END", "version": "CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 2 END", "tier": "CASE doc_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE 'high' END", "published_at": f"CASE WHEN doc_id % 7 > 0 THEN {TIMES} END", "generated_at": TIMES,
        "ai": "doc_id % 8 < 4", "ai_model": "CASE WHEN doc_id % 8 > 0 THEN 'm' END",
        "locations": "CASE doc_id % 9 WHEN 0 THEN slice(array(named_struct('country', 'US', 'admin1', 'US-NY', 'lat', 0D, 'lon', 0D)), 1, 0) WHEN 1 THEN array(named_struct('country', 'US', 'admin1', 'US-NY', 'lat', 91D, 'lon', 0D)) ELSE array(named_struct('country', 'US', 'admin1', NULL, 'lat', NULL, 'lon', 180D)) END",
        "sources": "CASE WHEN doc_id % 10 > 0 THEN array(named_struct('publisher', 'p', 'headline', 'h', 'url', concat('https://a.example/', doc_id), 'rights_mode', CASE WHEN doc_id % 10 = 1 THEN 'OTHER' ELSE 'LINK_ONLY' END, 'excerpt', NULL)) END",
    },
    rules.STORIES,
    {
        "id": "doc_id % 4 = 0", "headline": "NOT coalesce(least(doc_id % 230, length(text)) BETWEEN 8 AND 200, false)", "dek": "text IS NOT NULL AND least(doc_id % 350, length(text)) > 300", "body": "length(text) > 6000", "excerpt": "text IS NOT NULL AND least(doc_id % 330, length(text)) > 300",
        "category": "lang <> 'en' OR lang IS NULL", "version": "doc_id % 5 = 0", "tier": "doc_id % 6 = 0", "times": "doc_id % 7 = 0", "ai": "doc_id % 8 < 4 AND (doc_id % 8 = 0 OR text IS NULL)", "locations": "doc_id % 9 < 2", "sources": "doc_id % 10 < 2",
    },
)
register(
    "check_editions", "orders", "o_orderkey",
    {
        "edition_id": "CASE WHEN o_orderkey % 5 > 0 THEN concat('e-', o_orderkey) ELSE 'e' END", "kind": "CASE WHEN o_orderkey % 6 > 0 THEN 'morning' ELSE 'night' END", "generated_at": "o_orderdate", "country": "CASE o_orderkey % 7 WHEN 0 THEN 'usa' ELSE 'US' END", "label": "CASE WHEN o_orderkey % 8 > 0 THEN o_orderpriority END",
        "sections": "array(named_struct('id', 'local', 'title', CASE WHEN o_orderkey % 9 > 0 THEN 'Local' END, 'story_ids', array(o_custkey)))", "story_ids": "CASE WHEN o_orderkey % 10 > 0 THEN array(o_custkey) END",
    },
    rules.EDITIONS,
    {"edition_id": "o_orderkey % 5 = 0", "kind": "o_orderkey % 6 = 0", "generated_at": "o_orderdate IS NULL", "location": "o_orderkey % 7 = 0 OR o_orderkey % 8 = 0", "sections": "o_orderkey % 9 = 0", "stories": "o_orderkey % 10 = 0"},
)
register(
    "check_index", "orders", "o_orderkey",
    {
        "id": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END", "path": "CASE o_orderkey % 6 WHEN 0 THEN '/feeds/us/latest.json' WHEN 1 THEN 'feeds/us/latest_json' ELSE 'feeds/us/latest.json' END", "kind": "CASE o_orderkey % 7 WHEN 0 THEN 'night' WHEN 1 THEN NULL ELSE 'latest' END",
        "country": "'US'", "label": "CASE WHEN o_orderkey % 8 > 0 THEN 'l' END", "updated_at": "o_orderdate", "story_count": "CASE o_orderkey % 9 WHEN 0 THEN -1 WHEN 1 THEN NULL ELSE 0 END",
    },
    rules.INDEX,
    {"id": "o_orderkey % 5 = 0", "path": "o_orderkey % 6 < 2", "kind": "o_orderkey % 7 = 0", "location": "o_orderkey % 8 = 0", "updated_at": "o_orderdate IS NULL", "story_count": "o_orderkey % 9 = 0"},
)
register(
    "check_slices", "customer", "c_custkey",
    {"country": "CASE WHEN c_nationkey % 2 = 0 THEN 'US' ELSE c_mktsegment END", "generated_at": f"CASE WHEN c_custkey % 3 > 0 THEN {TIMES} END", "n": "CASE WHEN c_custkey % 5 > 0 THEN c_custkey END"},
    rules.SLICES,
    {"country": "c_nationkey % 2 = 1", "generated_at": "c_custkey % 3 = 0", "entries": "c_custkey % 5 = 0"},
)
