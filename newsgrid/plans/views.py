"""The driver's tables seen as news tables, once as DataFrames and once as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrid.operators.rank import small

#: Moment that stands for now in all queries over the star tables: 2001-08-02 00:00:00 UTC.
NOW = 996710400
RIGHTS_OF = "CASE {k} % 6 WHEN 0 THEN 'PUBLIC_DOMAIN' WHEN 1 THEN 'OPEN_LICENSE' WHEN 2 THEN 'RSS_EXCERPT_ALLOWED' WHEN 3 THEN 'METADATA_ONLY' WHEN 4 THEN 'LINK_ONLY' ELSE 'BLOCKED' END"
TYPE_OF = "CASE {k} % 8 WHEN 0 THEN 'nws-alerts' WHEN 1 THEN 'json-api' WHEN 2 THEN 'atom' WHEN 3 THEN 'gdelt' ELSE 'rss' END"
SECTION_OF = "CASE {k} % 5 WHEN 0 THEN 'local' WHEN 1 THEN 'regional' WHEN 2 THEN 'state' WHEN 3 THEN 'national' ELSE 'world' END"
CATEGORY_OF = "CASE {k} % 6 WHEN 0 THEN 'weather' WHEN 1 THEN 'public-safety' WHEN 2 THEN 'politics' WHEN 3 THEN 'sports' WHEN 4 THEN 'business' ELSE 'local' END"

#: Expressions valid in Spark and in DuckDB.
SOURCE_COLUMNS = ("s_suppkey AS source_id", "s_name AS name", "s_suppkey % 101 AS priority", f"{RIGHTS_OF.format(k='s_suppkey')} AS rights_mode", f"{TYPE_OF.format(k='s_suppkey')} AS type", "n_name AS country", "s_nationkey AS nation", "s_suppkey % 7 <> 0 AS enabled")
MEMBER_COLUMNS = ("l_orderkey AS cluster_id", "l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS item_id", "l_suppkey AS source_id", f"{SECTION_OF.format(k='l_partkey')} AS section", f"{CATEGORY_OF.format(k='l_partkey')} AS category")
#: Seconds from the order's date to the report.
LAG = "((l_partkey * 17 + l_suppkey * 29 + l_linenumber * 13) % 2000) * 60"
CLUSTER_COLUMNS = ("o_orderkey AS cluster_id", f"{SECTION_OF.format(k='o_custkey')} AS section", f"{CATEGORY_OF.format(k='o_custkey')} AS category")


#: Rows of a large table in one task at most, about: joins and groups hold a task's rows in memory, and partitions that are
#: made by the size of compressed rows would hold millions.
TASK_ROWS = 500_000


def dealt(key: str, large: DataFrame, *others: tuple[str, DataFrame]) -> list[DataFrame]:
    """large, and others that are joined to it, dealt by their keys into tasks in proportion to the rows of large; small
    tables, of which a task has no more rows anyway, stay as they are."""
    parts = -(-large.count() // TASK_ROWS)
    if parts <= large.sparkSession.sparkContext.defaultParallelism:
        return [large, *[df for _, df in others]]
    return [df.repartition(parts, k) for k, df in ((key, large), *others)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").join(small(table(spark, d, "nation")), F.expr("s_nationkey = n_nationkey")).selectExpr(*SOURCE_COLUMNS)


def members(spark: SparkSession, d: str) -> DataFrame:
    """Reports of clusters: published_at is a timestamp some hours after the order's date."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    lines, orders = dealt("l_orderkey", lines, ("o_orderkey", table(spark, d, "orders").select("o_orderkey", "o_orderdate")))
    joined = lines.join(orders, F.expr("l_orderkey = o_orderkey"))
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.expr(LAG))
    return joined.select(*[F.expr(c) for c in MEMBER_COLUMNS], at.alias("published_at"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*CLUSTER_COLUMNS)


def stories(spark: SparkSession, d: str) -> DataFrame:
    """Stories: orders with a score, a moment, a breaking flag and the customer's place ladder."""
    places = table(spark, d, "customer").join(small(table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey")).join(small(table(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    return table(spark, d, "orders").join(places, F.expr("o_custkey = c_custkey")).select(*[F.expr(c) for c in STORY_COLUMNS], F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("published_s"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """News items from documents: a headline of the first twelve words, all others as the excerpt, a moment in 2024."""
    words = F.split(F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \n\r\t]+", " ")), " ")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("source_id"),
        F.array_join(F.slice(words, 1, 12), " ").alias("headline"),
        F.array_join(F.slice(words, 13, F.greatest(F.size(words) - 12, F.lit(0))), " ").alias("excerpt"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/n/"), F.col("doc_id").cast("string")).alias("url"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60 * 7 % 2592000).alias("published_at"),
    )


STORY_COLUMNS = (
    "o_orderkey AS story_id", "o_totalprice / 600000.0 AS score", "o_orderpriority = '1-URGENT' AS breaking", f"{SECTION_OF.format(k='o_custkey')} AS section", f"{CATEGORY_OF.format(k='o_custkey')} AS category",
    "c_custkey % 20 AS city_no", "c_nationkey AS nation", "n_name AS state", "r_name AS country",
)

SQL = {
    "sources": f"SELECT {', '.join(SOURCE_COLUMNS)} FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "members": f"SELECT {', '.join(MEMBER_COLUMNS)}, epoch(o_orderdate)::BIGINT + {LAG} AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "clusters": f"SELECT {', '.join(CLUSTER_COLUMNS)} FROM orders",
    "stories": f"SELECT {', '.join(STORY_COLUMNS)}, epoch(o_orderdate)::BIGINT AS published_s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "items": r"""SELECT item_id, source_id, array_to_string(w[1:12], ' ') AS headline, array_to_string(w[13:], ' ') AS excerpt,
      'https://' || source_id || '.example.com/n/' || item_id AS url, 1704067200 + item_id * 60 * 7 % 2592000 AS ts
      FROM (SELECT doc_id AS item_id, source AS source_id, string_split(trim(regexp_replace(coalesce(text, ''), '[ \n\r\t]+', ' ', 'g')), ' ') AS w FROM documents)""",
}


def with_views(names: str, body: str) -> str:
    """DuckDB SQL with the named views in front; body starts with further CTEs ("x AS (...)," style) or SELECT."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {head}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
