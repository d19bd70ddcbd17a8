"""Queries over event clusters of two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid.operators import state
from newsgrid.plans.registry import query
from newsgrid.plans.views import NOW, table

#: The earlier run knows the first four lines of an order; the later run sees lines from the third on, and takes some
#: orders together with the one before.
LINES = "SELECT l_orderkey, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS item_id, l_suppkey AS source_id, l_linenumber, epoch(o_orderdate)::BIGINT AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
SQL = f"""WITH RECURSIVE lines AS ({LINES}),
pm AS (SELECT 'o' || l_orderkey AS event_id, item_id, source_id, day FROM lines WHERE l_linenumber <= 4 AND l_orderkey % 7 > 0),
nm AS (SELECT CASE WHEN l_orderkey % 4 = 1 THEN 'o' || (l_orderkey - 1) WHEN l_orderkey % 11 = 0 THEN 'old' || l_orderkey ELSE 'o' || l_orderkey END AS event_id, item_id, source_id, day + 86400 AS day FROM lines WHERE l_linenumber >= 3),
prev AS (SELECT event_id, min(day) AS first_seen_s, max(day) AS last_seen_s, 3 AS version, ['old' || event_id[2:]] AS aliases FROM pm GROUP BY event_id),
new AS (SELECT event_id, min(day) AS first_seen_s, max(day) AS last_seen_s FROM nm GROUP BY event_id),
keys AS (SELECT event_id AS key, event_id AS resolved FROM prev UNION ALL SELECT a.key, min(a.event_id) FROM (SELECT unnest(aliases) AS key, event_id FROM prev) a WHERE a.key NOT IN (SELECT event_id FROM prev) GROUP BY a.key),
resolved AS (SELECT new.event_id, coalesce(k.resolved, new.event_id) AS resolved FROM new LEFT JOIN keys k ON k.key = new.event_id),
owner AS (SELECT item_id, min(event_id) AS hit FROM pm GROUP BY item_id),
hits AS (SELECT event_id, hit, count(*) AS n_shared FROM (SELECT DISTINCT event_id, item_id FROM nm) JOIN owner USING (item_id) GROUP BY ALL),
cand AS (SELECT event_id, resolved AS c FROM resolved UNION SELECT event_id, hit FROM hits),
dated AS (SELECT cand.*, coalesce(p.first_seen_s, 9223372036854775807) AS age, p.event_id IS NOT NULL AS known FROM cand LEFT JOIN prev p ON p.event_id = c),
best AS (SELECT event_id, arg_min(c, (age, c)) AS oldest, arg_min(known, (age, c)) AS oldest_known, list(c) AS candidates FROM dated GROUP BY event_id),
hc AS (SELECT event_id, count(*) AS n, min(hit) AS lo, max(hit) AS hi FROM hits GROUP BY event_id),
j AS (SELECT r.event_id, r.resolved, b.*  EXCLUDE (event_id), coalesce(n, 0) AS n, lo, r.resolved IN (SELECT event_id FROM prev) AS there,
  coalesce(n, 0) > 1 OR (r.resolved IN (SELECT event_id FROM prev) AND coalesce(lo <> r.resolved OR hi <> r.resolved, false)) AS merge
  FROM resolved r JOIN best b USING (event_id) LEFT JOIN hc USING (event_id)),
alive0 AS (SELECT event_id, candidates, CASE WHEN merge THEN oldest_known WHEN there THEN true ELSE n = 1 END AS known,
  CASE WHEN merge AND oldest_known THEN oldest WHEN merge THEN event_id WHEN there THEN resolved WHEN n = 1 THEN lo ELSE event_id END AS survivor FROM j),
alive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY survivor ORDER BY event_id DESC) AS turn FROM alive0) WHERE turn = 1),
joined AS (SELECT DISTINCT survivor FROM alive a JOIN nm USING (event_id) WHERE known AND NOT EXISTS (SELECT 1 FROM pm WHERE pm.event_id = a.survivor AND pm.source_id = nm.source_id)),
merged AS (SELECT a.survivor AS event_id, CASE WHEN NOT known THEN 'new' WHEN a.survivor IN (SELECT survivor FROM joined) THEN 'updated' ELSE 'unchanged' END AS status,
  CASE WHEN NOT known THEN 1 ELSE p.version + (a.survivor IN (SELECT survivor FROM joined))::INT END AS version,
  list_sort(list_distinct(list_filter(list_concat(coalesce(p.aliases, []), CASE WHEN known THEN list_append(candidates, a.event_id) ELSE [] END), lambda x: x <> a.survivor))) AS aliases,
  n.first_seen_s, n.last_seen_s, a.event_id AS origin FROM alive a JOIN new n USING (event_id) LEFT JOIN prev p ON p.event_id = a.survivor),
absent AS (SELECT * FROM prev WHERE event_id NOT IN (SELECT event_id FROM merged)),
claims AS (SELECT * FROM (SELECT unnest(aliases) AS event_id, origin FROM merged) WHERE event_id IN (SELECT event_id FROM absent)),
absorbed AS (SELECT event_id FROM claims c WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.event_id = c.event_id AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.event_id = c.origin AND nm.item_id = pm.item_id))),
carried AS (SELECT event_id, 'unchanged' AS status, version, list_sort(aliases) AS aliases, first_seen_s, last_seen_s, NULL AS origin FROM absent WHERE event_id NOT IN (SELECT event_id FROM absorbed)) """


def _runs(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey")).select("l_orderkey", F.expr("l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS item_id"), F.col("l_suppkey").alias("source_id"), "l_linenumber", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("day"))
    pm = lines.filter("l_linenumber <= 4 AND l_orderkey % 7 > 0").selectExpr("concat('o', l_orderkey) AS event_id", "item_id", "source_id", "day")
    nm = lines.filter("l_linenumber >= 3").selectExpr("CASE WHEN l_orderkey % 4 = 1 THEN concat('o', l_orderkey - 1) WHEN l_orderkey % 11 = 0 THEN concat('old', l_orderkey) ELSE concat('o', l_orderkey) END AS event_id", "item_id", "source_id", "day + 86400 AS day")
    bounds = lambda m: m.groupBy("event_id").agg(F.min("day").alias("first_seen_s"), F.max("day").alias("last_seen_s"))
    prev = bounds(pm).withColumn("version", F.lit(3)).withColumn("aliases", F.array(F.concat(F.lit("old"), F.expr("substring(event_id, 2)"))))
    new = bounds(nm).withColumn("aliases", F.array().cast("array<string>"))
    return new, nm, prev, pm


@query("resolve_aliases", SQL + "SELECT event_id, resolved FROM resolved")
def resolve_aliases(spark, d):
    new, _, prev, _ = _runs(spark, d)
    return state.resolve_aliases(new.select("event_id"), prev)


@query("overlap_prev", SQL + "SELECT event_id, hit, n_shared FROM hits")
def overlap_prev(spark, d):
    _, nm, _, pm = _runs(spark, d)
    return state.overlap_prev(nm, pm)


@query("survivors", SQL + "SELECT event_id, survivor, known FROM alive0")
def survivors(spark, d):
    return state.survivors(*_runs(spark, d)).select("event_id", "survivor", "known")


@query("carry_forward", SQL + "SELECT event_id, version FROM carried")
def carry_forward(spark, d):
    new, nm, prev, pm = _runs(spark, d)
    return state.update_state(new, nm, prev, pm, NOW, 1e9).filter("origin IS NULL").select("event_id", "version")


@query("update_state", SQL + f"SELECT event_id, status, version, aliases, first_seen_s, last_seen_s FROM (SELECT * FROM merged UNION ALL SELECT * FROM carried) WHERE {NOW} - last_seen_s <= 2000 * 86400")
def update_state(spark, d):
    return state.update_state(*_runs(spark, d), NOW, 2000).drop("origin")


@query("prune", f"SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0 OR {NOW} - epoch(o_orderdate)::BIGINT <= 7 * 86400")
def prune(spark, d):
    seen = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 50 > 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("last_seen_s"))
    return state.prune(seen, NOW).select("o_orderkey")


@query("reusable_briefs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def reusable_briefs(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS brief_headline", "o_orderstatus AS brief_body", "sha2(o_orderstatus, 256) AS brief_fingerprint", "sha2(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'x' END, 256) AS fingerprint")
    return state.reusable_briefs(o).select("o_orderkey")


@query("store_briefs", "SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN substr(sha256(o_orderpriority || chr(10) || o_orderstatus), 1, 32) ELSE o_orderstatus END AS brief_hash FROM orders")
def store_briefs(spark, d):
    o = table(spark, d, "orders")
    briefs = o.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey AS event_id", "o_orderpriority AS headline", "o_orderstatus AS body")
    return state.store_briefs(o.selectExpr("o_orderkey AS event_id", "o_orderstatus AS brief_hash"), briefs).select("event_id", "brief_hash")


@query("scrub_records", "SELECT doc_id, contains(t, chr(65533)) AS damaged, length(replace(t, chr(65533), '')) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', chr(65533)) ELSE text END AS t FROM documents)")
def scrub_records(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit(state.REPLACEMENT))).otherwise(F.col("text")).alias("text"))
    return state.scrub(t, "text").select("doc_id", "damaged", F.length("text").cast("long").alias("n"))
