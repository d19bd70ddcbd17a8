import zlib
from collections import Counter

from pyspark.sql import functions as F

from newsgrid.llm import sharding
from tests.conftest import SMALL


def held(docs, shards=16):
    rows = sharding.op8_sharding(docs, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return rows


def test_law(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = held(docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.op8_sharding(docs.repartition(5)).collect()))
    held(odd)
    held(docs, 7)
    assert sharding.op8_sharding(none).count() == 0


def test_repeats_and_clashing_names(spark):
    same = spark.range(1000).select(F.lit(7).alias("x"), F.lit(None).cast("string").alias("shard"), F.lit(1).alias("_n"), F.lit(2).alias("_number"), F.lit("q").alias("a`b.c"))
    rows = sharding.shard_rows(same, 8).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 1000 and sharding.shard_rows(same, 8).columns == ["x", "_n", "_number", "a`b.c", "shard", "slot"]
    df, n = sharding.number_rows(same, "k", block=10)
    assert n == 1000 and sorted(r.k for r in df.collect()) == list(range(1000))


def test_permutation(spark):
    for n in (1, 2, 3, 5, 10, 64, 1000, 4097):
        p = spark.range(n).select("id", sharding.permute(F.col("id"), n, 9).alias("p")).withColumn("back", sharding.permute(F.col("p"), n, 9, inverse=True))
        rows = p.collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    column = spark.range(50).select(sharding.permute(F.col("id"), F.lit(50), F.lit(9)).alias("p"), sharding.permute(F.col("id"), 50, 9).alias("q")).collect()
    assert all(r.p == r.q for r in column)
