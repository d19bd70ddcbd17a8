"""Checks of briefs against their evidence.

evidence rows hold event_id, headline, dek, body of the brief and source_text (publishers, headlines and excerpts of the
cluster), dated_text (the same with dates) and places (names of the cluster's places in normal form).  Every check is an
expression that gives an array of reasons, empty if all is well, so all checks run in one projection.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid import vocab
from newsgrid.checkpoint import written
from newsgrid.operators.rank import small

STRINGS = "array<string>"


def norm(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _text(*fields: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])


def _reasons(label: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(f"{label}: "), x))


def _flag(condition: Column, reason: str) -> Column:
    return F.when(condition, F.array(F.lit(reason))).otherwise(F.array().cast(STRINGS))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _if_any(found: Column, use) -> Column:
    """use(found), an array of strings, where there is something in found: what it takes from the sources is only made then."""
    return _once(found, lambda f: F.when(F.size(f) > 0, use(f)).otherwise(F.array().cast(STRINGS)))


def _large(per_brief: DataFrame) -> DataFrame:
    """A table that grows with the briefs: joined by a shuffle at any size, as a dozen of them that are each just small enough
    to be broadcast do not fit the driver together."""
    return per_brief.hint("merge")


BRIEF = "headline string, dek string, body string, category string, people array<string>, organizations array<string>, sourceIds array<string>, confidence double"


def parse_briefs(raw: DataFrame) -> DataFrame:
    """Q1: (event_id, brief, reason): the JSON object in `raw`, code fences aside; a reason instead if there is none."""
    text = F.trim(F.coalesce("raw", F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    variant = F.try_parse_json(bare)
    what = F.schema_of_variant(variant)
    reason = F.when(text == "", "empty").when(variant.isNull(), "invalid JSON").when(~what.startswith("OBJECT"), "not an object")
    return raw.select("event_id", F.when(reason.isNull(), F.from_json(bare, BRIEF)).alias("brief"), reason.alias("reason"))


def parse_unsupported(raw: DataFrame) -> DataFrame:
    """Q1: (event_id, unsupported, reason) of fact-check answers {"unsupported": [...]}."""
    parsed = F.from_json("raw", "unsupported array<string>")["unsupported"]
    return raw.select("event_id", parsed.alias("unsupported"), F.when(parsed.isNull(), "unsupported must be an array").alias("reason"))


SCHEMA_RULES = {
    "headline": lambda: F.length("headline").between(1, 200),
    "body": lambda: F.length("body") >= 1,
    "category": lambda: F.col("category").isin(*vocab.TAXONOMY),
    "confidence": lambda: F.col("confidence").between(0, 1),
}
#: Rules of whole briefs: those above, and that the lists are there and sources are cited.
BRIEF_RULES = {
    **SCHEMA_RULES,
    "dek": lambda: F.col("dek").isNotNull(),
    "people": lambda: F.col("people").isNotNull(),
    "organizations": lambda: F.col("organizations").isNotNull(),
    "source_ids": lambda: F.col("source_ids").isNotNull(),
    "locations": lambda: F.col("locations").isNotNull(),
}


def check_source_ids(cited: DataFrame, members: DataFrame) -> DataFrame:
    """Q3: (event_id, reason): cited ids that are no member's id, source or URL, members without URL, briefs that cite none.

    cited: event_id, source_ids; members: event_id, item_id, source_id, url (strings)."""
    ids = members.select("event_id", F.explode(F.array("item_id", "source_id", "url")).alias("id")).filter("coalesce(trim(id), '') <> ''").select("event_id", F.lower(F.trim("id")).alias("id")).distinct()
    none = cited.filter(F.coalesce(F.size("source_ids"), F.lit(0)) <= 0).select("event_id", F.lit("no source ids").alias("reason"))
    asked = cited.select("event_id", F.explode("source_ids").alias("cited")).withColumn("id", F.lower("cited"))
    unknown = asked.join(_large(ids), ["event_id", "id"], "left_anti").select("event_id", F.concat(F.lit("unknown source id: "), "cited").alias("reason"))
    bare = members.filter("coalesce(trim(url), '') = ''").select("event_id", F.concat(F.lit("source without URL: "), F.col("item_id")).alias("reason"))
    return none.unionByName(unknown).unionByName(bare)


def check_entities() -> Column:
    """Q4: names of several words in body and dek that are neither in the sources nor places of the cluster."""
    spans = F.array_distinct(F.regexp_extract_all(_text("body", "dek"), F.lit("(?U)" + vocab.MULTI_WORD_NAME), F.lit(1)))

    def bad(spans: Column, source: Column) -> Column:
        known = lambda n: source.contains(n) | F.array_contains("places", n)

        def unsupported(span: Column) -> Column:
            core = F.regexp_replace(span, r"^(?:The|A|An)\s+", "")
            name = norm(core)
            rest = F.array_join(F.filter(F.split(name, " "), lambda w: ~w.isin(*vocab.WEEKDAYS)), " ")
            return core.contains(" ") & (name != "") & ~known(name) & ~((rest != "") & (rest != name) & (known(rest) | ~rest.contains(" ")))

        return F.filter(spans, unsupported)

    return _reasons("unsupported name", _if_any(spans, lambda found: _once(norm(F.col("source_text")), lambda source: bad(found, source))))


def check_listed(column: str) -> Column:
    """Q4: entries of people or organizations that are not in the sources."""
    return _reasons("unsupported " + column, _once(norm(F.col("source_text")), lambda source: F.filter(F.coalesce(F.col(column), F.array().cast(STRINGS)), lambda e: (norm(e) != "") & ~source.contains(norm(e)))))


def dates(text: Column) -> Column:
    """Dates of a text as structs (y, m, d), y null if not given; ISO, month and day, month/day."""
    whole = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = lambda c, pattern, g: F.nullif(F.regexp_extract(c, pattern, g), F.lit("")).try_cast("int")
    month = F.create_map(*[p for k, names in vocab.MONTHS.items() for n in names for p in (F.lit(n), F.lit(k))])
    date = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    iso = F.transform(whole(vocab.ISO_DATE), lambda c: date(number(c, r"(\d{4})-", 1), number(c, r"-(\d{2})-", 1), number(c, r"-(\d{2})$", 1)))
    named = F.transform(whole(vocab.MONTH_DAY), lambda c: date(number(c, r"(\d{4})$", 1), month[F.lower(F.regexp_extract(c, r"^([A-Za-z]+)", 1))], number(c, r"^[A-Za-z]+\s+(\d{1,2})", 1)))
    short = number
    year = lambda y: F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    slash = F.transform(whole(vocab.SLASH_DATE), lambda c: date(year(short(c, r"/\d{1,2}/(\d{2,4})$", 1)), short(c, r"^(\d{1,2})/", 1), short(c, r"^\d{1,2}/(\d{1,2})", 1)))
    found = F.filter(F.concat(iso, named, slash), lambda x: x["m"].between(1, 12) & x["d"].between(1, 31))
    return F.when(~text.rlike("[0-9]"), F.array().cast("array<struct<y:int,m:int,d:int>>")).otherwise(found)


def check_dates() -> Column:
    """Q5: dates of the brief that no source has; without a year any year will do."""

    def bad(known: Column) -> Column:
        lost = F.filter(dates(_text("headline", "dek", "body")), lambda x: ~F.exists(known, lambda k: (k["m"] == x["m"]) & (k["d"] == x["d"]) & F.coalesce(x["y"].isNull() | (k["y"] == x["y"]), F.lit(False))))
        return F.transform(lost, lambda x: F.concat_ws("-", F.coalesce(x["y"].cast("string"), F.lit("?")), x["m"].cast("string"), x["d"].cast("string")))

    return _reasons("date not in sources", _once(dates(F.col("dated_text")), bad))


def strip_dates(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), (vocab.ISO_DATE, vocab.MONTH_DAY, vocab.SLASH_DATE), text)


def numbers(text: Column) -> Column:
    """Numbers of a text without $, commas and %, dates aside."""
    found = F.transform(F.regexp_extract_all(strip_dates(text), F.lit(vocab.NUMBER), F.lit(0)), lambda n: F.translate(n, "$,%", ""))
    return F.when(~text.rlike("[0-9]"), F.array().cast(STRINGS)).otherwise(found)


def check_numbers() -> Column:
    """Q6: numbers of the brief that are equal to none in the sources."""
    def bad(known: Column) -> Column:
        mine = F.array_distinct(F.transform(numbers(_text("headline", "dek", "body")), lambda n: n.try_cast("double")))
        return F.transform(F.array_sort(F.array_except(mine, known)), lambda n: n.cast("string"))

    return _reasons("number not in sources", _once(F.transform(numbers(F.col("dated_text")), lambda n: n.try_cast("double")), bad))


def stem_of(t: str) -> str:
    """A light stemmer: endings of verbs and plurals, then a final e, go by length."""
    n = len(t)
    if n > 5 and t.endswith("ies"):
        return t[:-3] + "y"
    if n > 5 and t.endswith("ing"):
        t = t[:-3]
    elif n > 4 and t.endswith("ed"):
        t = t[:-2]
    elif n > 5 and t.endswith(("ses", "xes", "zes", "ches", "shes")):
        t = t[:-2]
    elif n > 3 and t.endswith("s") and not t.endswith("ss"):
        t = t[:-1]
    return t[:-1] if len(t) > 3 and t.endswith("e") else t


def stem(t: Column) -> Column:
    return F.pandas_udf(lambda words: words.map(stem_of, na_action="ignore"), "string")(t)


_WORD, _SKIPPED = re.compile("[a-z0-9]+"), frozenset(vocab.COVERAGE_SKIP)


@lru_cache(maxsize=1 << 16)
def _counted(word: str) -> str | None:
    """The stem of a word that counts."""
    return stem_of(word) if len(word) >= 3 and word not in _SKIPPED else None


def _any_thin(body: pd.Series, source: pd.Series, places: pd.Series, months: pd.Series) -> pd.Series:
    """Whether under 60 % of the words of a sentence, of five or more, are words of the source and the places or months; body:
    lower-case sentences.  Time grows with the words of a brief and its sources."""
    def thin(sentence: str, known: set) -> bool:
        own = [s for s in map(_counted, _WORD.findall(sentence)) if s is not None]
        return len(own) >= 5 and sum(s in known for s in own) < 0.6 * len(own)

    out = np.zeros(len(body), bool)
    for i, (sentences, text, names, stems) in enumerate(zip(body, source, places, months)):
        # without a list of places or a dated text nothing counts as known
        given = names is not None and stems is not None
        known = {_counted(w) for w in {w for t in (text, *names) for w in _WORD.findall(t)}}.union(stems) if given else set()
        out[i] = any(thin(s, known) for s in sentences)
    return pd.Series(out)


#: Stands for a stop that ends no sentence while a text is cut.
_STOP = "\x01"


def sentences(text: Column) -> Column:
    """Sentences of a text; the stops of abbreviations, titles and initials do not end one."""
    masked = F.regexp_replace(text, r"\.(?<=\b[A-Za-z]\.)(?=[A-Za-z]\.)", _STOP)
    masked = F.regexp_replace(masked, rf"\.(?<={_STOP}[A-Za-z]\.)", _STOP)
    masked = F.regexp_replace(masked, rf"(?=[A-Zve])\b([A-Z]|{vocab.TITLES})\.", f"$1{_STOP}")
    return F.filter(F.transform(F.split(masked, "[.!?]+"), lambda s: F.trim(F.replace(s, F.lit(_STOP), F.lit(".")))), lambda s: s != "")


def check_background() -> Column:
    """Q7: banned phrases that no source has; a date of reporting; a sentence with under 60 % of its words covered."""
    filler = _flag(_text("body", "dek").rlike(vocab.REPORTED_ON), "background: was reported on <date>")

    said = _once(norm(_text("body", "dek")), lambda own: F.array_compact(F.array(*[F.when(own.contains(p), F.lit(p)) for p in vocab.BANNED_PHRASES])))
    banned = _reasons("background", _if_any(said, lambda found: _once(norm(F.col("source_text")), lambda source: F.filter(found, lambda p: ~source.contains(p)))))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    months_known = F.flatten(F.transform(dates(F.col("dated_text")), lambda x: F.element_at(F.array(*[F.array(*[F.lit(stem_of(n)) for n in names]) for names in vocab.MONTHS.values()]), x["m"])))
    thin = F.pandas_udf(_any_thin, "boolean")(F.transform(sentences(F.coalesce("body", F.lit(""))), low), low(F.col("source_text")), F.transform("places", low), months_known)
    return F.concat(filler, banned, _flag(thin, "background: sentence under 60 % covered"))


def check_locations(brief_locations: DataFrame, cluster_locations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q9: (event_id, location) of brief locations that are no location of the cluster, whose names the sources and places
    lack, and that are not just the cluster's country.  Locations are structs (country, admin1, admin2, city, metro)."""
    fields = ("country", "admin1", "admin2", "city", "metro")
    key = lambda c: F.concat_ws("|", *[F.lower(F.coalesce(F.col(c)[f], F.lit(""))) for f in fields])
    known = cluster_locations.select("event_id", key("location").alias("key")).distinct()
    open_ = brief_locations.withColumn("key", key("location")).join(_large(known), ["event_id", "key"], "left_anti")
    names = F.filter(F.array(*[norm(F.col("location")[f]) for f in fields[1:]]), lambda n: n != "")
    backed = open_.join(_large(evidence.select("event_id", norm(F.col("source_text")).alias("source"), "places")), "event_id", "left")
    backed = backed.filter(~F.coalesce(F.exists(names, lambda n: F.col("source").contains(n) | F.array_contains("places", n)), F.lit(False)))
    countries = cluster_locations.select("event_id", F.upper(F.col("location.country")).alias("land")).distinct()
    only = F.size(names) == 0
    same = backed.withColumn("land", F.upper(F.col("location.country"))).withColumn("only", only)
    return same.join(_large(countries.withColumn("there", F.lit(True))), ["event_id", "land"], "left").filter(~(F.col("only") & F.coalesce("there", F.lit(False)))).select("event_id", "location")


def check_outcomes() -> Column:
    """Q10: outcomes that the brief states and no source does."""
    text, source = _text("headline", "dek", "body"), F.coalesce("source_text", F.lit(""))
    # most briefs state none, which one pattern tells
    some = text.rlike(f"(?iU)(?=[acdfgijkpsw])(?:{'|'.join(vocab.OUTCOMES.values())})")
    named = F.array_compact(F.array(*[F.when(text.rlike("(?iU)" + p) & ~source.rlike("(?iU)" + p), F.lit(f"unsupported outcome: {name}")) for name, p in vocab.OUTCOMES.items()]))
    return F.when(some, named).otherwise(F.array().cast(STRINGS))


def check_event_location() -> Column:
    """Q11: places where the brief says that something happened, unless the sources name them or they are the cluster's."""
    found = F.array_distinct(F.regexp_extract_all(_text("headline", "dek", "body"), F.lit(vocab.EVENT_IN), F.lit(1)))
    return _reasons("unsupported event location", _if_any(found, lambda said: _once(norm(F.col("source_text")), lambda source: F.filter(said, lambda p: (norm(p) != "") & ~source.contains(norm(p)) & ~F.array_contains("places", norm(p))))))


def check_containment(gazetteer: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q12: (event_id, area): sentences that say a place lies in a county or state, with no known pairing for the area.

    gazetteer: city, county, states (array), in normal form; event_id is the evidence's key.  A pairing is known if a city of the sentence lies there by
    the gazetteer, or the sources state it.
    """
    sentence = evidence.select("event_id", norm(F.col("source_text")).alias("source"), F.posexplode(sentences(_text("body", "dek"))).alias("n", "s")).filter(reduce(lambda a, b: a | b, [F.col("s").rlike(p) for p in vocab.CONTAINED]))
    padded = F.concat(F.lit(" "), norm(F.col("s")), F.lit(" "))
    sentence, at = sentence.withColumn("padded", padded), ["event_id", "n"]
    states = gazetteer.select(F.explode("states").alias("area")).distinct()
    # words and runs of words of the sentence are matched with the gazetteer by equality
    w = F.split(F.trim("padded"), " ")
    grams = F.flatten(F.transform(F.array(*[F.lit(i) for i in range(1, 5)]), lambda k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast(STRINGS))))
    runs = sentence.select("event_id", "n", "source", F.explode(F.array_distinct(grams)).alias("run"))
    counties = sentence.select("event_id", "n", "source", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(vocab.COUNTY), F.lit(1)), norm))).alias("area"))
    named = runs.join(small(states), F.col("run") == F.col("area")).select("event_id", "n", "source", "area")
    mentions = counties.unionByName(named).distinct()
    free = runs.join(_large(mentions.select(*at, F.col("area").alias("whole"))), at).withColumn("inside", F.concat(F.lit(" "), "whole", F.lit(" ")).contains(F.concat(F.lit(" "), "run", F.lit(" "))))
    cities = free.groupBy(*at, "run").agg(F.bool_or("inside").alias("inside")).filter("NOT inside").join(small(gazetteer), F.col("run") == F.col("city")).select(*at, "city", "county", "states")
    paired = mentions.join(_large(cities), at).filter((F.col("area") == F.col("county")) | F.array_contains("states", F.col("area")) | F.col("source").contains(F.concat("city", F.lit(" in "), "area")) | F.col("source").contains(F.concat("city", F.lit(" is located in "), "area")))
    return mentions.join(_large(paired.select(*at, "area")), [*at, "area"], "left_anti").select("event_id", "area").distinct()


def check_length() -> Column:
    """Q13: headline to 110, dek to 200 characters, body from max(30, min(60, 0.4 source words)) to 220 words."""
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    floor = F.greatest(F.lit(30), F.least(F.lit(60), F.floor(count(F.col("source_text")) * 0.4)))
    n = count(F.col("body"))
    return F.concat(_flag(F.length("headline") > 110, "headline too long"), _flag(F.length("dek") > 200, "dek too long"), _flag((n < floor) | (n > 220), "body length"))


def grams(rows: DataFrame, key: str, text: str, n: int = 12) -> DataFrame:
    """(key, gram): 64-bit hashes of all runs of n words of a text, each once per key."""
    def runs(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return rows.select(key, F.explode(_once(words(F.col(text)), runs)).alias("gram"))


def check_verbatim(fields: DataFrame, closed: DataFrame, n: int = 12) -> DataFrame:
    """Q14: (event_id, source_id) that share a run of n words; fields: event_id, text; closed (not openly licensed): source_id, text."""
    # Spark takes the runs for as few as the texts and would send those of all briefs to the driver
    return _large(grams(fields, "event_id", "text", n)).join(small(written(grams(closed, "source_id", "text", n))), "gram").select("event_id", "source_id").distinct()


def check_quotes() -> Column:
    """Q15: quotations of three characters or more that the sources lack; marks without a quotation."""
    text = _text("headline", "dek", "body")
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    quoted = F.concat(F.regexp_extract_all(text, F.lit('"([^"]{3,})"'), F.lit(1)), F.regexp_extract_all(text, F.lit("“([^”]{3,})”"), F.lit(1)))
    fake = _if_any(quoted, lambda found: _once(flat(F.coalesce("source_text", F.lit(""))), lambda s: F.filter(found, lambda q: ~s.contains(flat(q)))))
    return F.when(text.rlike('["“”]') & (F.size(quoted) == 0), F.array(F.lit("quotation marks without a quotation"))).otherwise(_reasons("fake quote", F.transform(fake, lambda q: F.substring(q, 1, 120))))


def check_stitching() -> Column:
    """Q16: phrases that join reports of different events."""
    text = F.lower(_text("headline", "dek", "body"))
    return _flag(reduce(lambda a, b: a | b, [text.contains(p) for p in vocab.STITCHING_PHRASES]), "narrative stitching")


def numbers_in_context(members: DataFrame, width: int = 5) -> DataFrame:
    """Q8: (event_id, source_id, number, context): each number of a source with the words around it."""
    tokens = F.regexp_extract_all(strip_dates(F.coalesce("text", F.lit(""))), F.lit("[A-Za-z0-9$%.,/-]+"), F.lit(0))
    rows = members.withColumn("tokens", tokens).select("event_id", "source_id", "tokens", F.posexplode("tokens").alias("i", "token"))
    rows = rows.withColumn("number", F.explode(F.transform(F.regexp_extract_all("token", F.lit(vocab.NUMBER), F.lit(0)), lambda n: F.translate(n, "$,%", ""))))
    near = F.array_join(F.slice("tokens", F.greatest(F.lit(1), F.col("i") + 1 - width), F.least(F.col("i"), F.lit(width)) + 1 + width), " ")
    context = F.array_distinct(F.filter(words(near), lambda w: (F.length(w) >= 3) & ~w.isin(*vocab.BRIEF_STOP_WORDS)))
    return rows.select("event_id", "source_id", "number", context.alias("context"))


def check_disagreement(members: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q8: (event_id, first, second): numbers of the same kind from different sources that the brief does not both give.

    The pairs are of distinct numbers within one event, and an event's sources bound them.
    """
    seen = numbers_in_context(members)
    per = seen.groupBy("event_id", "number").agg(F.collect_set("source_id").alias("holders"), F.array_distinct(F.flatten(F.collect_list("context"))).alias("context"))
    several = members.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("event_id")
    per = per.join(_large(several), "event_id", "left_semi")
    a, b = (per.select("event_id", F.col("number").alias(n), F.array_sort("holders").alias(f"h{i}"), F.col("context").alias(f"c{i}")) for i, n in ((1, "first"), (2, "second")))
    shared = F.array_intersect("c1", "c2")
    affected = F.array(*[F.lit(w) for w in vocab.AFFECTED_WORDS])
    kind = (F.size(shared) >= 2) | F.arrays_overlap("c1", affected) | F.arrays_overlap("c2", affected) | ((F.size(shared) >= 1) & (F.col("first").try_cast("double") > 10) & (F.col("second").try_cast("double") > 10))
    pairs = a.join(_large(b), "event_id").filter((F.col("first") < F.col("second")) & ~((F.col("h1") == F.col("h2")) & (F.size("h1") == 1)) & kind)
    own = evidence.select("event_id", F.transform(numbers(_text("body", "dek")), lambda n: n.try_cast("double")).alias("own"))
    both = F.array_contains("own", F.col("first").try_cast("double")) & F.array_contains("own", F.col("second").try_cast("double"))
    return pairs.join(_large(own), "event_id").filter(~F.coalesce(both, F.lit(False))).select("event_id", "first", "second")


CHECKS = {"entities": check_entities, "dates": check_dates, "numbers": check_numbers, "background": check_background, "outcomes": check_outcomes, "event_location": check_event_location, "length": check_length, "quotes": check_quotes, "stitching": check_stitching}


def with_reasons(evidence: DataFrame, *more: DataFrame) -> DataFrame:
    """(event_id, ok, reasons) of the checks that are expressions and of `more`, tables (event_id, reason) of others."""
    own = evidence.select("event_id", F.concat(*[f() for f in CHECKS.values()]).alias("reasons"))
    if more:
        found = reduce(DataFrame.unionByName, [t.select("event_id", "reason") for t in more]).groupBy("event_id").agg(F.sort_array(F.collect_set("reason")).alias("more"))
        own = own.join(_large(found), "event_id", "left").select("event_id", F.concat("reasons", F.coalesce("more", F.array().cast(STRINGS))).alias("reasons"))
    return own.select("event_id", (F.size("reasons") == 0).alias("ok"), "reasons")


def validate_briefs(evidence: DataFrame, members: DataFrame, cluster_locations: DataFrame, gazetteer: DataFrame, closed: DataFrame) -> DataFrame:
    """Q17: (event_id, ok, reasons) of all fourteen checks.

    evidence: event_id (its key), headline, dek, body, category, confidence, people, organizations, source_ids, locations
    (structs country, admin1, admin2, city, metro), source_text, dated_text, places.  members: event_id, item_id,
    source_id, url, text.  cluster_locations: event_id, location.  gazetteer: as in check_containment.  closed: source_id,
    text of sources that are not openly licensed.
    """
    # every check reads these; as tables, so that no plan holds how they came about once a check
    evidence, members = written(evidence), written(members)
    reason = lambda label, *c: F.concat(F.lit(f"{label}: "), *c).alias("reason")
    listed = [evidence.select("event_id", F.explode(check_listed(c)).alias("reason")) for c in ("people", "organizations")]
    schema = evidence.select("event_id", F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(f(), F.lit(False)), F.lit(f"schema: {k}")) for k, f in BRIEF_RULES.items()]))).alias("reason"))
    ids = check_source_ids(evidence.select("event_id", "source_ids"), members.select("event_id", *[F.col(c).cast("string").alias(c) for c in ("item_id", "source_id", "url")]))
    differing = check_disagreement(members, evidence).select("event_id", reason("sources disagree", "first", F.lit(" and "), "second"))
    place = F.array_join(F.array_compact(F.array(*[F.col("location")[f] for f in ("city", "admin2", "metro", "admin1", "country")])), ", ")
    placed = check_locations(evidence.select("event_id", F.explode("locations").alias("location")), cluster_locations, evidence).select("event_id", reason("location not in sources", place))
    contained = check_containment(gazetteer, evidence).select("event_id", reason("containment", "area"))
    copied = check_verbatim(evidence.select("event_id", _text("headline", "dek", "body").alias("text")), closed).select("event_id", reason("verbatim copy of", F.col("source_id").cast("string")))
    return with_reasons(evidence, *listed, schema, ids, differing, placed, contained, copied)


def acceptance_rate(validated: DataFrame) -> DataFrame:
    """Q17: share of briefs without a reason."""
    return validated.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("rate"))


def downgrade(stories: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stories with `ai` off and `downgraded` on where an outcome or an event's place is not in the sources."""
    bad = evidence.filter((F.size(check_outcomes()) > 0) | (F.size(check_event_location()) > 0)).select(F.col("event_id").alias("story_id"), F.lit(True).alias("bad"))
    joined = stories.join(bad, "story_id", "left").withColumn("downgraded", F.col("ai") & F.coalesce("bad", F.lit(False)))
    return joined.withColumn("ai", F.col("ai") & ~F.col("downgraded")).drop("bad")
