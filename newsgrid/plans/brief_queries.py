"""Queries of the brief checks: each document is a brief, the next document is its evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgrid import vocab
from newsgrid.operators import briefs as b
from newsgrid.plans.registry import query
from newsgrid.plans.views import table

PLACES = ("and", "thin on", "nation 3")


def evidence(spark, d):
    docs = table(spark, d, "documents")
    own = docs.select(F.col("doc_id").alias("event_id"), F.substring("text", 1, 120).alias("headline"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('He said "'), F.substring("text", 10, 30), F.lit('". In other news, all died.'))).otherwise("").alias("dek"), F.col("text").alias("body"))
    near = docs.select((F.col("doc_id") - 1).alias("event_id"), F.col("text").alias("source_text"), F.col("text").alias("dated_text"))
    # texts are not broadcast, and a shuffle spreads those of one file over all tasks
    return own.join(near.hint("merge"), "event_id").withColumn("places", F.array(*map(F.lit, PLACES)))


E = """e AS (SELECT a.doc_id AS event_id, a.text[:120] AS headline, CASE WHEN a.doc_id % 5 = 0 THEN 'He said "' || a.text[10:39] || '". In other news, all died.' ELSE '' END AS dek, a.text AS body, b.text AS source,
  trim(regexp_replace(lower(b.text), '[^a-z0-9]+', ' ', 'g')) AS ns FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""
NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
OUTCOME = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '(?i){p}') AND NOT regexp_matches(s, '(?i){p}') THEN 'unsupported outcome: {n}' END" for n, p in vocab.OUTCOMES.items()) + "], lambda x: x IS NOT NULL)"
LATIN = "regexp_replace({}, '[À-ɏ]', '_', 'g')"


def of(check, name="reasons"):
    return lambda spark, d: evidence(spark, d).select("event_id", check().alias(name))


query("check_entities", f"""WITH {E}, s AS (SELECT event_id, ns, unnest(list_distinct(regexp_extract_all({LATIN.format("body || ' ' || dek")}, '\\b([A-Z][a-z]{{2,}}(?:\\s+[A-Z][a-z]{{2,}})+)\\b', 1))) AS span FROM e),
c AS (SELECT *, regexp_replace(span, '^(The|A|An)\\s+', '') AS core FROM s), n AS (SELECT *, {NORM.format('core')} AS name, array_to_string(list_filter(string_split({NORM.format('core')}, ' '), lambda w: w NOT IN ({', '.join(repr(w) for w in vocab.WEEKDAYS)})), ' ') AS rest FROM c)
SELECT event_id, span FROM n WHERE contains(core, ' ') AND name <> '' AND NOT (contains(ns, name) OR name IN {PLACES}) AND NOT (rest <> '' AND rest <> name AND (contains(ns, rest) OR rest IN {PLACES} OR NOT contains(rest, ' ')))""")(
    lambda spark, d: evidence(spark, d).select("event_id", F.explode(b.check_entities()).alias("r")).select("event_id", F.expr("substring(r, 19)").alias("span"))
)

query("check_people", f"WITH {E}, p AS (SELECT event_id, ns, unnest([headline[1:12], 'Zed Zedson']) AS x FROM e) SELECT event_id, count(*) AS n FROM p WHERE {NORM.format('x')} <> '' AND NOT contains(ns, {NORM.format('x')}) GROUP BY event_id")(
    lambda spark, d: evidence(spark, d).withColumn("people", F.array(F.substring("headline", 1, 12), F.lit("Zed Zedson"))).select("event_id", F.explode(b.check_listed("people"))).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
)


@query("check_dates", "SELECT o_orderkey AS event_id, (o_custkey % 2 = 1)::INT::BIGINT AS n FROM orders")
def check_dates(spark, d):
    """Q5: the brief gives the order's date, its source gives it too or is a day off."""
    o = table(spark, d, "orders")
    day, near = F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 2).cast("int"))
    form = lambda c, k: F.when(k == 0, F.date_format(c, "'Sent on' MMMM d, yyyy.")).when(k == 1, F.date_format(c, "'On' M/d/yyyy 'it came.'")).otherwise(F.date_format(c, "'At' yyyy-MM-dd'T09:00:00Z'"))
    e = o.select(F.col("o_orderkey").alias("event_id"), F.lit("").alias("headline"), F.lit("").alias("dek"), form(day, F.col("o_orderkey") % 3).alias("body"), form(near, F.col("o_custkey") % 3).alias("dated_text"))
    return e.select("event_id", F.size(b.check_dates()).cast("long").alias("n"))


@query("check_numbers", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS n FROM lineitem")
def check_numbers(spark, d):
    """Q6: prices written in two ways, and a number that only the brief has."""
    li = table(spark, d, "lineitem")
    e = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.lit("").alias("headline"), F.lit("").alias("dek"), F.concat(F.lit("It cost $"), F.format_number("l_extendedprice", 2), F.when(F.col("l_linenumber") % 2 == 1, F.lit(" and 1234567890.5%")).otherwise("")).alias("body"), F.concat(F.lit("Paid: "), F.format_string("%.2f", "l_extendedprice")).alias("dated_text"))
    return e.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.size(b.check_numbers()).cast("long").alias("n"))


SKIP = ", ".join(repr(w) for w in vocab.COVERAGE_SKIP)
STEM = """CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN w[:-4] || 'y' ELSE regexp_replace(CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-3]
  WHEN length(w) > 5 AND regexp_matches(w, '(ses|xes|zes|ches|shes)$') THEN w[:-3] WHEN length(w) > 3 AND regexp_matches(w, '[^s]s$') THEN w[:-2] ELSE w END, '^(....*)e$', '\\1') END"""


@query("stem", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), k AS (SELECT w FROM w WHERE length(w) >= 3 AND w NOT IN ({SKIP})) SELECT w, {STEM} AS stem FROM k")
def stem(spark, d):
    """The words that count in Q7, with their stems."""
    w = table(spark, d, "documents").select(F.explode(F.array_distinct(b.words(F.col("text")))).alias("w")).distinct()
    return w.filter((F.length("w") >= 3) & ~F.col("w").isin(*vocab.COVERAGE_SKIP)).select("w", b.stem(F.col("w")).alias("stem"))


@query("check_background", f"""WITH {E}, v AS (SELECT event_id, list_distinct(list_transform(list_filter(regexp_extract_all(lower(source) || ' and thin on nation 3', '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({SKIP})), lambda w: {STEM})) AS v, body FROM e),
m AS (SELECT event_id, v, string_split_regex(regexp_replace(regexp_replace(regexp_replace(body, '\\b([A-Za-z])\\.([A-Za-z])\\.', '\\1' || chr(1) || '\\2' || chr(1), 'g'), '(' || chr(1) || '[A-Za-z])\\.', '\\1' || chr(1), 'g'), '\\b([A-Z]|{vocab.TITLES})\\.', '\\1' || chr(1), 'g'), '[.!?]+') AS s FROM v),
w AS (SELECT event_id, v, list_transform(list_filter(regexp_extract_all(lower(unnest(s)), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({SKIP})), lambda w: {STEM}) AS own FROM m),
r AS (SELECT event_id, bool_or(len(own) >= 5 AND len(list_filter(own, lambda x: list_contains(v, x))) < 0.6 * len(own)) AS thin FROM w GROUP BY event_id) SELECT event_id, thin FROM r""")
def check_background(spark, d):
    """Q7: thin sentences; the phrases are in check_phrases."""
    return evidence(spark, d).withColumn("dated_text", F.lit("")).select("event_id", F.array_contains(b.check_background(), "background: sentence under 60 % covered").alias("thin"))


@query("check_phrases", "SELECT c_custkey AS event_id, (c_custkey % 3 = 0)::INT::BIGINT + (c_custkey % 5 = 0 AND c_custkey % 2 = 1)::INT::BIGINT AS n FROM customer")
def check_phrases(spark, d):
    """Q7: reporting dates and banned phrases."""
    e = table(spark, d, "customer").selectExpr("c_custkey AS event_id", "'' AS dek", "concat(c_name, CASE WHEN c_custkey % 3 = 0 THEN ' was  Reported on May 3' ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN '. No-Casualty, as per the Places' ELSE '' END) AS body", "CASE WHEN c_custkey % 2 = 0 THEN 'As per the places. A casualty.' ELSE 'A casualty' END AS source_text", "'' AS dated_text", "array('x') AS places")
    reasons = F.filter(b.check_background(), lambda r: ~r.contains("covered") & ~r.contains("as per places"))
    return e.select("event_id", F.size(reasons).cast("long").alias("n"))


query("check_outcomes", f"WITH {E} SELECT event_id, {OUTCOME} AS reasons FROM (SELECT event_id, {LATIN.format('headline || chr(32) || dek || chr(32) || body')} AS t, {LATIN.format('source')} AS s FROM e)")(of(b.check_outcomes))


@query("check_event_location", "SELECT c_custkey AS event_id, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_nationkey = 3 THEN 0 ELSE 1 END::BIGINT AS n FROM customer")
def check_event_location(spark, d):
    """Q11: an event placed in a nation, which the source names for every third one and which nation 3 always is."""
    names = ["Alba", "Borea", "Cora", "Nation Three", *[f"Land {chr(65 + i)}" for i in range(30)]]
    name = F.element_at(F.array(*map(F.lit, names)), F.col("c_nationkey") + 1)
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("event_id"), F.lit("").alias("headline"), F.lit("").alias("dek"), F.concat(F.lit("The crash took place in the "), name, F.lit(", they say.")).alias("body"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("In "), F.upper(name))).otherwise("Elsewhere").alias("source_text"), F.array(F.lit("nation three")).alias("places"))
    return e.select("event_id", F.size(b.check_event_location()).cast("long").alias("n"))


query("check_length", f"""WITH {E}, n AS (SELECT event_id, length(headline) AS h, length(dek) AS k, len(list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '')) AS w, greatest(30, least(60, floor(len(list_filter(string_split_regex(source, '\\s+'), lambda w: w <> '')) * 0.4))) AS floor FROM e)
SELECT event_id, list_concat(CASE WHEN h > 110 THEN ['headline too long'] ELSE [] END, CASE WHEN w < floor OR w > 220 THEN ['body length'] ELSE [] END) AS reasons FROM n""")(of(b.check_length))

query("check_quotes", f"""WITH {E}, t AS (SELECT event_id, headline || ' ' || dek || ' ' || body AS t, trim(regexp_replace(lower(source), '\\s+', ' ', 'g')) AS s FROM e), q AS (SELECT *, list_concat(regexp_extract_all(t, '"([^"]{{3,}})"', 1), regexp_extract_all(t, '“([^”]{{3,}})”', 1)) AS q FROM t)
SELECT event_id, CASE WHEN regexp_matches(t, '["“”]') AND len(q) = 0 THEN ['quotation marks without a quotation'] ELSE list_transform(list_filter(q, lambda x: NOT contains(s, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')))), lambda x: 'fake quote: ' || x[:120]) END AS reasons FROM q""")(of(b.check_quotes))

query("check_stitching", f"WITH {E} SELECT event_id, CASE WHEN contains(t, 'another story') OR contains(t, 'another report from') OR contains(t, 'a separate story') OR contains(t, 'in other news') THEN ['narrative stitching'] ELSE [] END AS reasons FROM (SELECT event_id, lower(headline || ' ' || dek || ' ' || body) AS t FROM e)")(of(b.check_stitching))


@query("check_verbatim", """WITH d AS (SELECT doc_id AS event_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), q AS (SELECT item_id AS source_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
dg AS (SELECT DISTINCT event_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT event_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)), qg AS (SELECT DISTINCT source_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT source_id, w, unnest(range(1, len(w) - 10)) AS i FROM q))
SELECT DISTINCT event_id, source_id FROM dg JOIN qg USING (g)""")
def check_verbatim(spark, d):
    """Q14: documents that copy twelve words or more of a benchmark passage."""
    return b.check_verbatim(table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"), "text"))


@query("check_source_ids", "SELECT o_orderkey AS event_id, 'unknown source id: X' || o_custkey AS reason FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'no source ids' FROM orders WHERE o_orderkey % 7 = 1 AND o_orderkey % 3 > 0 UNION ALL SELECT l_orderkey, 'source without URL: ' || l_partkey FROM lineitem WHERE l_linenumber = 13 UNION ALL SELECT o_orderkey, 'unknown source id: X' || o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 3 = 0")
def check_source_ids(spark, d):
    members = table(spark, d, "lineitem").selectExpr("l_orderkey AS event_id", "cast(l_partkey AS string) AS item_id", "concat('S', l_suppkey) AS source_id", "CASE WHEN l_linenumber = 13 THEN ' ' ELSE concat('u', l_partkey) END AS url")
    known = members.groupBy("event_id").agg(F.min("source_id").alias("one"))
    cited = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey").join(known, "event_id", "left")
    cited = cited.select("event_id", F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("X"), F.col("o_custkey").cast("string")))).when(F.col("event_id") % 7 == 1, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.lower("one")))).alias("source_ids"))
    cited = cited.filter((F.col("event_id") % 3 == 0) | (F.col("event_id") % 7 == 1) | (F.size("source_ids") > 0))
    return b.check_source_ids(cited, members)


@query("check_locations", "SELECT c_custkey AS event_id FROM customer WHERE c_nationkey % 5 <> c_custkey % 5 AND c_custkey % 4 <> 1 AND c_custkey % 7 <> 0")
def check_locations(spark, d):
    """Q9: a brief's city, which is the cluster's, or named in the sources, or left out so that the country counts."""
    c = table(spark, d, "customer")
    place = lambda city: F.struct(F.lit("US").alias("country"), F.lit(None).cast("string").alias("admin1"), F.lit(None).cast("string").alias("admin2"), city.alias("city"), F.lit(None).cast("string").alias("metro"))
    mine = c.select(F.col("c_custkey").alias("event_id"), place(F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit("Town"), F.col("c_nationkey") % 5))).alias("location"))
    theirs = c.select(F.col("c_custkey").alias("event_id"), place(F.concat(F.lit("Town"), F.col("c_custkey") % 5)).alias("location"))
    text = c.select(F.col("c_custkey").alias("event_id"), F.when(F.col("c_custkey") % 4 == 1, "Town0, town1, TOWN2; Town3 and town4.").otherwise("Nowhere").alias("source_text"), F.array().cast("array<string>").alias("places"))
    return b.check_locations(mine, theirs, text).select("event_id")


@query("check_containment", "SELECT c_custkey AS event_id, 'county' || ' ' || chr((97 + (c_custkey % 3))::INT) || ' county' AS area FROM customer WHERE c_nationkey % 3 <> c_custkey % 3 AND c_custkey % 4 > 0")
def check_containment(spark, d):
    """Q12: a town said to lie in a county: true by the gazetteer, or stated by the source, or neither."""
    c = table(spark, d, "customer")
    town = F.concat(F.lit("Town "), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("c_nationkey") % 3 + 1).cast("int")))
    county = F.concat(F.lit("County "), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("c_custkey") % 3 + 1).cast("int")), F.lit(" County"))
    e = c.select(F.col("c_custkey").alias("event_id"), F.concat(town, F.lit(" is located in "), county, F.lit(". More.")).alias("body"), F.lit("").alias("dek"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("See "), town, F.lit(" in "), county)).otherwise("Nothing").alias("source_text"))
    gazetteer = spark.createDataFrame([(f"town {x}", f"county {x} county", ["new land"]) for x in "abc"], "city string, county string, states array<string>")
    return b.check_containment(gazetteer, e)


@query("check_disagreement", """WITH m AS (SELECT l_orderkey AS event_id, l_suppkey AS source_id, (10 + l_linenumber)::VARCHAR AS n FROM lineitem), h AS (SELECT event_id, n, list_sort(list(DISTINCT source_id)) AS h FROM m GROUP BY ALL), several AS (SELECT event_id FROM m GROUP BY event_id HAVING count(*) > 1)
SELECT a.event_id, a.n AS first, b.n AS second FROM h a JOIN h b ON a.event_id = b.event_id AND a.n < b.n WHERE NOT (a.h = b.h AND len(a.h) = 1) AND a.event_id IN (SELECT event_id FROM several) AND a.event_id % 5 > 0""")
def check_disagreement(spark, d):
    """Q8: sources that give different numbers of homes; every fifth brief gives them all."""
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("source_id"), F.concat(F.lit("About "), F.col("l_linenumber") + 10, F.lit(" homes lost power")).alias("text"))
    every = " ".join(str(i) for i in range(11, 30))
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 5 == 0, every).otherwise("many homes").alias("body"), F.lit("").alias("dek"))
    return b.check_disagreement(m, e)


@query("parse_briefs", "SELECT c_custkey AS event_id, CASE WHEN c_custkey % 5 < 2 THEN c_name END AS headline, CASE c_custkey % 5 WHEN 2 THEN 'empty' WHEN 3 THEN 'invalid JSON' WHEN 4 THEN 'not an object' END AS reason FROM customer")
def parse_briefs(spark, d):
    """Q1."""
    raw = F.expr("""CASE c_custkey % 5 WHEN 0 THEN to_json(named_struct('headline', c_name, 'confidence', 0.5)) WHEN 1 THEN concat('```json\n', to_json(named_struct('headline', c_name, 'extra', 1)), '\n```') WHEN 2 THEN '  ' WHEN 3 THEN concat('{"headline": "', c_name) ELSE '[1, 2]' END""")
    return b.parse_briefs(table(spark, d, "customer").select(F.col("c_custkey").alias("event_id"), raw.alias("raw"))).select("event_id", "brief.headline", "reason")


@query("check_schema", "SELECT c_custkey, r.rule FROM customer, (VALUES ('category'), ('confidence'), ('headline')) r(rule) WHERE CASE rule WHEN 'category' THEN c_mktsegment <> 'HOUSEHOLD' WHEN 'confidence' THEN c_acctbal NOT BETWEEN 0 AND 5000 ELSE c_custkey % 9 = 0 END")
def check_schema(spark, d):
    """The brief's rules as a table of violations."""
    from newsgrid.operators.normalize import violations

    rows = table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 9 > 0 THEN c_name END AS headline", "c_name AS body", "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'local' ELSE c_mktsegment END AS category", "c_acctbal / 5000 AS confidence")
    return violations(rows, "c_custkey", {k: f() for k, f in b.SCHEMA_RULES.items()})


@query("validate_documents")
def validate_documents(spark, d):
    """The checks that need no lists over all documents: SQL has the single checks."""
    e = evidence(spark, d)
    copied = b.check_verbatim(e.select("event_id", "body").withColumnRenamed("body", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("source_id"), "text")).select("event_id", F.concat(F.lit("verbatim copy of "), F.col("source_id").cast("string")).alias("reason"))
    return b.with_reasons(e, copied)


BASE = "the river rose over the low road near the old mill on friday and crews closed the bridge while people from the town moved cars and tools to higher ground before the water came down again in the night"
CLOSED = "five small boats left the harbour at dawn with bread salt rope and lamps for the far islands"
#: What the k-th kind of brief says besides BASE, what of it changes, and the reason that this must give.
FAULTS = (
    ("", {}, None),
    (" Zed Zedson spoke.", {}, "unsupported name: Zed Zedson"),
    ("", {"people": "array('Ann Other')"}, "unsupported people: Ann Other"),
    ("", {"organizations": "array('Big Org')"}, "unsupported organizations: Big Org"),
    (" It was on May 3, 2020.", {}, "date not in sources: 2020-5-3"),
    (" It cost 77 crowns.", {}, "number not in sources: 77.0"),
    (" Strange purple elephants danced under bright moons.", {}, "background: sentence under 60 % covered"),
    (" A man was arrested.", {}, "unsupported outcome: arrest"),
    (" The crash took place in the Alba, they say.", {}, "unsupported event location: Alba"),
    ("", {"headline": "repeat('river ', 19)"}, "headline too long"),
    (' He said "made up words".', {}, "fake quote: made up words"),
    (" In other news, calm.", {}, "narrative stitching"),
    ("", {"confidence": "2.0D"}, "schema: confidence"),
    ("", {"source_ids": "array('X9')"}, "unknown source id: X9"),
    ("", {"report": "concat('About ', l_linenumber + 10, ' homes lost power')"}, "sources disagree: 11 and 12"),
    ("", {"city": "'Farville'"}, "location not in sources: Farville, US"),
    (" Town A is located in County B County.", {}, "containment: county b county"),
    (" Five small boats left the harbour at dawn with bread salt rope.", {}, "verbatim copy of: 1"),
    ("", {"source_ids": "array()"}, "no source ids"),
    (" U.S.A. crews closed the low road bridge near the old mill.", {}, None),
)


def _case(field, default):
    return "CASE k " + " ".join(f"WHEN {i} THEN {change[field]}" for i, (_, change, _) in enumerate(FAULTS) if field in change) + f" ELSE {default} END AS {field}"


WANTED = "CASE k " + " ".join(f"WHEN {i} THEN ['{r}']" for i, (_, _, r) in enumerate(FAULTS) if r) + " ELSE [] END"


#: The fault whose reasons are all pairs of an order's lines.
TORN = next(i for i, (_, change, _) in enumerate(FAULTS) if "report" in change)


@query("validate_briefs", f"""WITH n AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS ns FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey, o_custkey % {len(FAULTS)} AS k, list_sort(flatten(list_transform(ns, lambda a: list_transform(list_filter(ns, lambda b: b > a), lambda b: 'sources disagree: ' || (a + 10) || ' and ' || (b + 10))))) AS torn FROM orders JOIN n ON l_orderkey = o_orderkey)
SELECT o_orderkey AS event_id, CASE WHEN k = {TORN} THEN torn ELSE {WANTED} END AS reasons, len(CASE WHEN k = {TORN} THEN torn ELSE {WANTED} END) = 0 AS ok FROM o""")
def validate_briefs(spark, d):
    """Q17: a brief for each order, with one fault or none, against all its lines as sources; all fourteen checks."""
    lines = table(spark, d, "lineitem")
    o = table(spark, d, "orders").join(lines.select("l_orderkey").distinct().hint("merge"), F.expr("l_orderkey = o_orderkey"), "left_semi").selectExpr("o_orderkey AS event_id", f"cast(o_custkey % {len(FAULTS)} AS int) AS k")
    body = F.concat(F.lit(f"{BASE}."), F.element_at(F.array(*[F.lit(extra) for extra, _, _ in FAULTS]), F.col("k") + 1))
    e = o.withColumn("body", body).selectExpr("event_id", _case("headline", "'river rose over road'"), "'crews closed the bridge' AS dek", "body", "'local' AS category", _case("confidence", "0.5D"), _case("people", "array('Crews')"), _case("organizations", "cast(array() AS array<string>)"), _case("source_ids", "array('S1')"), _case("city", "cast(NULL AS string)"), f"'{BASE}; crash took place say. {' '.join(reversed(CLOSED.split()))}' AS source_text", "'' AS dated_text", "array('town c') AS places")
    e = e.withColumn("locations", F.array(F.struct(F.lit("US").alias("country"), *[F.lit(None).cast("string").alias(f) for f in ("admin1", "admin2")], F.col("city").alias("city"), F.lit(None).cast("string").alias("metro"))))
    members = lines.join(o, F.expr("l_orderkey = event_id")).selectExpr("event_id", "concat('I', l_linenumber) AS item_id", "concat('S', l_linenumber) AS source_id", "concat('https://x/', l_linenumber) AS url", _case("report", "'the river rose'").replace(" AS report", " AS text"))
    members = members.unionByName(o.selectExpr("event_id", "'I9' AS item_id", "'S1' AS source_id", "'https://x/9' AS url", "'nothing else' AS text"))
    theirs = o.select("event_id", F.struct(F.lit("US").alias("country"), F.lit("US-NY").alias("admin1"), F.lit(None).cast("string").alias("admin2"), F.lit("Troy").alias("city"), F.lit(None).cast("string").alias("metro")).alias("location"))
    gazetteer = spark.createDataFrame([("town a", "county a county", ["new land"])], "city string, county string, states array<string>")
    return b.validate_briefs(e, members, theirs, gazetteer, spark.createDataFrame([(1, CLOSED)], "source_id int, text string"))


@query("acceptance_rate", f"WITH {E}, n AS (SELECT event_id, len(list_filter(string_split_regex(body, '\\s+'), lambda w: w <> '')) AS w, greatest(30, least(60, floor(len(list_filter(string_split_regex(source, '\\s+'), lambda w: w <> '')) * 0.4))) AS floor, length(headline) AS h FROM e) SELECT count(*) AS n, round(avg((h <= 110 AND w BETWEEN floor AND 220)::INT), 9)::DOUBLE AS rate FROM n")
def acceptance_rate(spark, d):
    ok = evidence(spark, d).select("event_id", (F.size(b.check_length()) == 0).alias("ok"))
    return b.acceptance_rate(ok).withColumn("rate", F.round("rate", 9))


@query("downgrade", f"WITH {E}, o AS (SELECT event_id, len({OUTCOME}) > 0 AS bad FROM (SELECT event_id, {LATIN.format('headline || chr(32) || dek || chr(32) || body')} AS t, {LATIN.format('source')} AS s FROM e)) SELECT doc_id AS story_id, doc_id % 2 = 0 AND coalesce(bad, false) AS downgraded, doc_id % 2 = 0 AND NOT coalesce(bad, false) AS ai FROM documents LEFT JOIN o ON event_id = doc_id")
def downgrade(spark, d):
    stories = table(spark, d, "documents").select(F.col("doc_id").alias("story_id"), (F.col("doc_id") % 2 == 0).alias("ai"))
    return b.downgrade(stories, evidence(spark, d)).select("story_id", "downgraded", "ai")
