"""The written index finds what the plain one finds, and reads the ranges of a prefix only."""

import random

from pyspark.sql import functions as F

from newsgrid.operators import library


def test_written_index(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    rows = [(s, w) for s in range(0, 400000, 997) for w in {rng.choice(words) for _ in range(12)} | {"every"}]
    index = spark.createDataFrame(rows, "story_id long, term string")
    stories = index.select("story_id").distinct().withColumns({"published_s": F.col("story_id") % 1013, "category": F.lit("local")})
    library.write_search_index(index, str(tmp_path / "i"), ranges=16)
    files = len(spark.read.parquet(str(tmp_path / "i/postings")).inputFiles())
    for text in ("a", "ab", "abc d", "e", "every b", "eve", "zz", "ed edc", "a b c", "bcd"):
        want = [r.story_id for r in library.search(index, stories, text).collect()]
        assert [r.story_id for r in library.search_written(str(tmp_path / "i"), stories, text).collect()] == want
    whole = spark.read.parquet(str(tmp_path / "i/postings"))
    assert whole.groupBy("term").count().filter("count > 1").count() > 0  # blocks of a long list
    plan = lambda *terms: len(library.postings(spark, str(tmp_path / "i"), list(terms)).inputFiles())
    # of 16 ranges a prefix of two letters is read from three at most, an unknown word from one at most
    assert files >= 14 and plan("ab") <= 3 and plan("zz") <= 1 and plan("every") <= 2
