"""Columns of the input that are named like any helper column of the operators are carried along or replaced, never mixed up."""

import glob
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import newsgrid.llm
from newsgrid.llm import mixing, near_dedup, packing, quality, repair, sharding, simhash, suffix_dedup, variants, warc
from tests.conftest import SMALL

SOURCES = "".join(open(f).read() for f in sorted(glob.glob(f"{list(newsgrid.llm.__path__)[0]}/*.py")))
#: Every name in quotes in the modules that starts with an underscore or is short, as those of helper columns are.
NAMES = sorted({n.lower() for n in re.findall(r'"(_[A-Za-z_0-9]+|[A-Za-z][A-Za-z_0-9]{0,3})"', SOURCES)} - {"doc_id", "text", "lang", "source", "n_chars", "page_id", "url", "html", "conv_id", "turn", "role"})


def widened(df):
    return df.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(NAMES)])


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    return d.union(d.filter("doc_id % 9 = 0"))


@pytest.mark.parametrize("stage", [near_dedup.near_dedup_stage, mixing.mixing_stage, quality.quality_stage])
def test_stages(docs, stage):
    wide = widened(docs)
    got = stage(wide)
    assert got.columns == wide.columns
    plain = Counter(tuple(r) for r in stage(docs).select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.text) for r in got.select("doc_id", "text").collect()) == plain
    assert all(r[n] == f"x{i}" for r in got.limit(5).collect() for i, n in enumerate(NAMES))


def test_operators(spark, docs):
    for op in (mixing.op1_mixing, packing.op4_packing, simhash.op7_simhash, sharding.op8_sharding, quality.op9_quality, variants.op11_variants, suffix_dedup.op12_suffix_dedup):
        assert Counter(map(str, op(widened(docs)).collect())) == Counter(map(str, op(docs).collect()))
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert Counter(map(str, repair.op13_repair(widened(turns)).collect())) == Counter(map(str, repair.op13_repair(turns).collect()))
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    resolved = warc.resolve(widened(pages))
    key = lambda r: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
    assert Counter(map(key, resolved.collect())) == Counter(map(key, warc.resolve(pages).collect()))
    assert set(resolved.columns) >= set(NAMES)
    pieces = packing.tokenize(docs)
    held = [n for n in NAMES if n not in pieces.columns]
    packed = packing.pack(pieces.select("*", *[F.lit("x").alias(n) for n in held]))
    assert packed.count() == pieces.count() and packed.select("sequence_id", "offset").dtypes == [("sequence_id", "bigint"), ("offset", "bigint")]
