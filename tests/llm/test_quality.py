import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from newsgrid.llm.queries import ORACLE_SQL
from newsgrid.llm.quality import STOP_WORDS, judge, op9_quality, quality_stage
from tests.conftest import SMALL


def by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    repeat = len({j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    stop = sum(x.lower() in STOP_WORDS for x in w)
    failed = n < 50 or 100 * repeat > 50 * n
    kept = not failed and 2.5 <= chars / n <= 12 and symbols / n <= 0.1 and stop / n >= 0.06 and dup <= 0.5 * len(lines)
    return n, chars, symbols, dup, repeat, failed, kept, stop


def test_against_hand(spark, odd, none):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd):
        rows = docs.collect()
        assert Counter(tuple(r) for r in op9_quality(docs).collect()) == Counter((r.doc_id, *by_hand(r.text)) for r in rows)
        stage = quality_stage(docs)
        assert stage.columns == docs.columns and Counter(map(tuple, stage.collect())) == Counter(tuple(r) for r in rows if by_hand(r.text)[6])
    assert op9_quality(none).count() == 0 and quality_stage(none).count() == 0


def test_labels(spark):
    """Good documents of 50 words stay, bad ones go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = judge(docs).filter("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r["share"] for r in rows}
    assert share[1] > 0.98 and share[0] < 0.1


def test_clashing_columns(spark, odd):
    out = judge(odd.withColumn("n_words", F.lit("x")).withColumn("_m", F.lit(1)))
    assert out.columns.count("n_words") == 1 and out.columns.count("kept") == 1 and out.count() == odd.count()


def test_plan_is_native(spark):
    plan = op9_quality(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_uncovered_languages(spark):
    """Clean texts of languages without a list stay, in scripts without blanks too; junk and covered languages are judged as before."""
    letters = lambda a: " ".join("".join(chr(a + (i * i * 31 + i * 17 + j * j * (i + 5)) % 23) for j in range(4 + i % 5)) for i in range(80))
    han = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(300))
    cut = " ".join(han[i : i + 5] for i in range(0, 300, 5))
    rows = [(1, letters(0x430), "ru"), (2, letters(0x3B1), "el"), (3, letters(0x61), "pl"), (4, letters(0x61), None), (5, han, "zh"), (6, letters(0x61), "en"), (7, letters(0x61), "de-AT"), (8, han[:30], "zh"), (9, "ab cd ef " * 60, "pl"), (10, "x" * 500, "pl"), (11, cut, "zh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = op9_quality(docs).collect()
    assert {r.doc_id for r in found if r.kept} == {1, 2, 3, 4, 11} and {r.doc_id for r in quality_stage(docs).collect()} == {1, 2, 3, 4, 5, 11}
    assert not any(r.kept and r.base_failed for r in found)
    con = duckdb.connect()
    con.register("documents", pa.table({k: [r[i] for r in rows] for i, k in enumerate(("doc_id", "text", "lang"))}))
    assert {d: k for d, k in con.execute(f"SELECT doc_id, kept FROM ({ORACLE_SQL['op9_quality']})").fetchall()} == {r.doc_id: r.kept for r in found}
