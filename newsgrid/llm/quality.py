"""Quality rules: a table of thresholds compiled into one Spark projection (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid.llm.common import SPACES, col, fresh, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the four languages of the corpus; a parameter of the operator.
STOP_WORDS = tuple(
    """the of and to in is that it was for with on as be by this are from at not he his or an have which
    le la les de des du un une et en que est pour dans qui par au sur pas avec ce il elle
    der die das und ist von den mit ein eine nicht zu im auf sich dem
    el los las y por con para del se su no es lo como más una""".split()
)
#: Languages that STOP_WORDS covers; texts of other or unknown languages have no bound on stop words.
COVERED = ("en", "fr", "de", "es")
#: Characters of scripts that put no blanks between words; each counts as a word where they are most of a text.
#: Ranges of Thai, Lao, Myanmar, Khmer, Kana and Han (fixed values), all of three bytes or more in UTF-8.
UNSPACED = r"[\x{E01}-\x{EDF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3041}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}]"
#: measure, least, most: a document keeps only if every measure lies between its bounds (None: no bound).
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_chars", 2.5, 12.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.06, None),
    ("dup_line_ratio", None, 0.5),
)
MEASURES = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for each row, wherever the optimizer puts the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(w: Column) -> Column:
    """64-bit hashes of the three-word windows of a text's words."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    chain = lambda h: F.zip_with(F.zip_with(h, F.slice(h, 2, F.size(h)), lambda x, y: F.xxhash64(x, y)), F.slice(h, 3, F.size(h)), lambda x, y: F.xxhash64(x, y))
    every = _once(hashed, lambda h: F.slice(chain(h), 1, F.size(h) - 2))
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(every)


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a three-word window found twice or more; windows are compared by 64-bit hashes.

    The windows are sorted with their places, equal neighbours are found twice or more, and the places they cover are
    counted once each.  A text whose windows all differ is done after one pass over a hash set.
    """
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))

    def again(s: Column) -> Column:
        near = F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(none)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)).otherwise(F.array().cast("array<int>")))
        return F.size(F.array_distinct(F.flatten(near)))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_once(placed, again))


def measures(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """n_words, n_lines, n_unspaced and the MEASURES of a text as one struct of longs; a null or blank text has zero of everything.

    n_unspaced is counted only where such characters can be most of the text's, else it is zero.
    """
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def of(w: Column, x: Column) -> Column:
        added = {
            "n_words": F.size(w),
            "n_lines": F.size(x),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, "")),
            "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
            "n_repeat_words": _once(_windows(w), _repeat_words),
            # they matter where they are most of the letters, and each has two bytes more than characters
            "n_unspaced": F.when(F.octet_length(body) - F.length(body) > F.length(F.array_join(w, "")), F.length(body) - F.length(F.regexp_replace(body, UNSPACED, ""))).otherwise(0),
            "n_stop_words": F.size(F.filter(w, lambda v: F.lower(v).isin(*stop_words))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in added.items()])

    return _once(words_of(body), lambda w: _once(lines, lambda x: of(w, x)))


def covered(docs: DataFrame, lang: str = "lang") -> Column:
    """Whether a document's language column names a language of STOP_WORDS (regions such as en-GB included)."""
    if lang.lower() not in {c.lower() for c in docs.columns}:
        return F.lit(False)
    return F.coalesce(F.lower(F.regexp_extract(col(lang).cast("string"), r"^\s*([A-Za-z]+)", 1)).isin(*COVERED), F.lit(False))


def verdict(m: Column, known: Column, rules: tuple[tuple[str, float | None, float | None], ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, fit) of a struct of measures: the threshold table as one boolean expression.

    Stop words are bounded only in known (covered) languages.  Where most characters are UNSPACED, each of them counts
    as a word for n_words, and mean_word_chars has no bound; such a text can be fit although its words between blanks
    are too few (base_failed).
    """
    n, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
    unspaced = 2 * m["n_unspaced"] > m["word_chars"]
    ratios = {"n_words": F.when(unspaced, F.greatest(m["n_words"], m["n_unspaced"])).otherwise(m["n_words"]), "repeat_word_ratio": m["n_repeat_words"] / n, "mean_word_chars": m["word_chars"] / n, "symbol_ratio": m["n_symbols"] / n, "stop_word_ratio": m["n_stop_words"] / n, "dup_line_ratio": m["n_dup_lines"] / lines}
    free = {"mean_word_chars": unspaced, "stop_word_ratio": ~known}
    ratios["symbol_ratio"] = m["n_symbols"] / F.greatest(ratios["n_words"], F.lit(1))
    bounds = [free.get(k, F.lit(False)) | (ratios[k] >= F.lit(lo)) for k, lo, _ in rules if lo is not None] + [free.get(k, F.lit(False)) | (ratios[k] <= F.lit(hi)) for k, _, hi in rules if hi is not None]
    repeats = 100 * m["n_repeat_words"] > 50 * m["n_words"]
    base = (m["n_words"] < 50) | repeats
    return base, ~repeats & reduce(and_, bounds, F.lit(True))


def judge(docs: DataFrame, text: str = "text", rules: tuple[tuple[str, float | None, float | None], ...] = RULES, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """docs with n_words, the MEASURES, base_failed (fewer than 50 words, or over half the words in repeated windows) and
    kept, which is false where base_failed is true.

    Input columns named like these are replaced.
    """
    added = ("n_words", *MEASURES, "base_failed", "kept")
    (m,) = fresh(docs, "_m")
    rows = docs.withColumn(m, measures(col(text), stop_words))
    base, fit = verdict(col(m), covered(docs), rules)
    return rows.select(*[col(c) for c in docs.columns if c.lower() not in added], *[col(m)[k].alias(k) for k in added[:-2]], base.alias("base_failed"), (~base & fit).alias("kept"))


def op9_quality(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document, its whole text read; a null text has zero words and fails, repeated rows are
    judged alike, an empty table gives an empty one."""
    return judge(docs.select("doc_id", "text", *[c for c in docs.columns if c.lower() == "lang"])).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words")


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of documents.

    A null, empty or blank text has no words and goes; a text of any length is read whole; repeated rows are judged each
    for itself and alike; a null or unknown lang has no bound on stop words.  A text of a script without blanks is judged
    by its characters, so it can stay where op9_quality, which counts words between blanks alone, rejects it.  An empty
    table stays empty; columns of any other name are carried along.
    """
    return docs.filter(_once(measures(col("text")), lambda m: verdict(m, covered(docs))[1]))
