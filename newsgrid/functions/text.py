"""Scalar functions over URLs, markup, headlines and entities.  All are built-in expressions but `unescape_all`."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrid import vocab

REPLACEMENT = "�"


def strip_replacement(text: Column) -> Column:
    """Without U+FFFD; null becomes empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(REPLACEMENT), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of white space, no-break spaces included, become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate(text: Column, limit: int) -> Column:
    """The first `limit` characters without spaces at the end; limit 0 or less: as it is."""
    return text if limit <= 0 else F.when(F.length(text) > limit, F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", "")).otherwise(text)


def _encode(part: Column) -> Column:
    """Form encoding that leaves letters, digits and _.-~ as they are."""
    return F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, path parameters, tracking parameters or AMP marks, sorted parameters.

    A URL that cannot be parsed gives null.
    """
    u = F.trim(url)
    part = lambda name: F.try_parse_url(u, F.lit(name))
    scheme = F.lower(F.coalesce(part("PROTOCOL"), F.lit("https")))
    host = F.lower(part("HOST"))
    port = F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.coalesce(F.nullif(part("PATH"), F.lit("")), F.lit("/")), r";[^/]*$", "")
    bare = F.rtrim(path, F.lit("/"))
    path = F.when(bare.endswith("/amp"), F.coalesce(F.nullif(F.regexp_replace(bare, "/amp$", ""), F.lit("")), F.lit("/"))).otherwise(path)
    pairs = F.transform(F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))

    def kept(p: Column) -> Column:
        k = F.lower(p["k"])
        return ~(k.isin(*vocab.TRACKING_PARAMS) | k.startswith("utm_") | (k == "amp") | ((k == "output") & (F.lower(p["v"]) == "amp")))

    query = F.array_join(F.transform(F.array_sort(F.filter(pairs, kept)), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(F.trim(url), F.lit("HOST")), F.lit("")))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_tags(markup: Column) -> Column:
    """Scripts, styles and tags become spaces."""
    out = F.coalesce(markup, F.lit(""))
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return F.regexp_replace(out, "<[^>]+>", " ")


def html_to_text(markup: Column) -> Column:
    """Text of markup with the common entities; for the rest see unescape_all."""
    out = strip_tags(markup)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(strip_replacement(out))


def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def html_to_text_all(markup: Column) -> Column:
    """N2 with every named and numbered entity: the one step that needs Python, in Arrow batches."""
    return collapse(strip_replacement(F.pandas_udf(_unescape, T.StringType())(strip_tags(markup))))


def item_id(url: Column) -> Column:
    """N5."""
    return F.substring(F.sha2(url, 256), 1, 32)


def event_id(url: Column) -> Column:
    """N5."""
    return F.substring(F.sha2(url, 256), 1, 16)


def normalize_headline(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 without the headline stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*vocab.HEADLINE_STOP_WORDS)), " ")


def classify_category(headline: Column, excerpt: Column, source_type: Column) -> Column:
    """By source type, then by the first category with a keyword in the text (substrings), else local."""
    text = F.lower(F.concat_ws(" ", F.coalesce(headline, F.lit("")), F.coalesce(excerpt, F.lit(""))))

    def of(text: Column, source_type: Column) -> Column:
        quake = text.contains("earthquake") | text.contains("magnitude") | F.substring(text, 1, 8).contains("m ")
        out = F.when(source_type == "nws-alerts", "weather").when(quake & (source_type == "json-api"), "science")
        for name, words in vocab.CATEGORY_KEYWORDS:
            hit = text.contains(words[0])
            for w in words[1:]:
                hit = hit | text.contains(w)
            out = out.when(hit, name)
        return out.otherwise(vocab.DEFAULT_CATEGORY)

    # in an array, so that the text is made once and not for each keyword
    return F.element_at(F.transform(F.array(F.struct(text.alias("t"), source_type.alias("s"))), lambda x: of(x["t"], x["s"])), 1)


def extract_entities(text: Column) -> Column:
    """Capitalised spans, one word or more, lower case, each once, without the stop words."""
    spans = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*)\b"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(spans, lambda s: ~s.isin(*vocab.ENTITY_STOP_WORDS)), lambda s: F.lower(s)))


def norm_place(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "-_", "  "), r"(?U)\s+", " ")))


def place_aliases(name: Column) -> Column:
    """Normal form of a place name, without its generic ending, and with st, mt, ft spelled in the other ways."""
    norm = norm_place(name)
    forms = [norm, F.regexp_replace(norm, vocab.PLACE_SUFFIXES, "")]
    for group in vocab.PLACE_PREFIXES:
        for prefix in group:
            longer = [p for p in group if p != prefix and p.startswith(prefix)]
            starts = norm.startswith(prefix)
            for p in longer:
                starts = starts & ~norm.startswith(p)
            rest = F.trim(F.substring(norm, len(prefix) + 1, 1 << 20))
            forms.append(F.when(starts & (rest != ""), rest))
            forms += [F.when(starts & (rest != ""), F.concat(F.lit(other), rest)) for other in group if other != prefix]
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != ""))))


def snippet(dek: Column, excerpt: Column, body: Column, headline: Column, limit: int = 160) -> Column:
    """Dek, else excerpt, else the start of the body up to a word's end with an ellipsis; null if three quarters of
    its words are in the headline."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))
    flat = collapse(F.coalesce(body, F.lit("")))
    cut = F.regexp_replace(F.substring(flat, 1, limit), r"\s+\S*$", "")
    preview = F.when(F.length(flat) > limit, F.concat(cut, F.lit("…"))).otherwise(flat)
    best = F.coalesce(*[F.nullif(collapse(F.coalesce(c, F.lit(""))), F.lit("")) for c in (dek, excerpt, preview)])
    mine = words(best)
    same = F.size(F.array_intersect(mine, words(headline))) >= 0.75 * F.size(mine)
    return F.when((F.size(mine) > 0) & ~same, best)


def photo_matches_place(attribution: Column, places: Column) -> Column:
    """Some word of the attribution equals a word of a place, or they share a beginning of six letters or more."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2)
    mine, theirs = words(attribution), F.flatten(F.transform(places, words))
    near = lambda a, b: (a == b) | ((F.length(b) >= 6) & a.startswith(b)) | ((F.length(a) >= 6) & b.startswith(a))
    return F.exists(mine, lambda a: F.exists(theirs, lambda b: near(a, b)))


def is_allowed_license(name: Column) -> Column:
    """Public domain, CC0, CC BY or CC BY-SA; never with a non-commercial, no-derivatives or sampling mark."""
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    refused = F.lit(False)
    for mark in vocab.LICENSE_REFUSED:
        refused = refused | text.contains(f" {mark} ")
    return text.rlike(r" (cc0|public domain|pd|cc by|cc by sa|attribution) ") & ~refused & ~text.rlike("noncommercial|noderiv")


def normalize_postal(code: Column, country: Column) -> Column:
    """Five digits of a US code (also of ZIP+4 and nine digits); elsewhere upper case without spaces at the ends or runs."""
    clean = F.upper(F.trim(F.regexp_replace(F.coalesce(code, F.lit("")), r"\s+", " ")))
    us = F.regexp_extract(clean, r"^(\d{5})(?:-?\d{4})?$", 1)
    return F.when(F.upper(country) == "US", F.nullif(us, F.lit(""))).otherwise(F.nullif(clean, F.lit("")))


def title_matches(title: Column, query: Column) -> Column:
    """Every word of the query of three letters or more is in the title."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*vocab.HEADLINE_STOP_WORDS))
    return (F.size(words(query)) > 0) & (F.size(F.array_except(words(query), words(title))) == 0)


def image_queries(city: Column, entities: Column, county: Column, metro: Column, most: int = 6) -> Column:
    """City, names of two to five words and 60 characters at most, county, metro; each once, `most` at most."""
    names = F.filter(entities, lambda e: (F.size(F.split(e, " ")) >= 2) & (F.size(F.split(e, " ")) <= 5) & (F.length(e) <= 60))
    every = F.concat(F.array(city), names, F.array(county, metro))
    return F.slice(F.array_distinct(F.transform(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.lower(x))), 1, most)
