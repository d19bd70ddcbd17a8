import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsgrid.llm import warc
from tests.conftest import SMALL


def by_hand(rows):
    groups, out = defaultdict(list), Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        groups[body].append(page)
    for body, pages in groups.items():
        digest = hashlib.sha1(body).hexdigest()
        top = max(pages, key=lambda p: (p is not None, p or 0))
        first = True
        for p in pages:
            original = len(body) < 1000 or (p == top and first)
            first = first and not (p == top)
            out[p, len(body), digest, "response" if original else "revisit", None if original else top] += 1
    return out


def pages(spark):
    p = spark.read.parquet(f"{SMALL}/pages.parquet")
    odd = spark.createDataFrame([(9000, None, None), (9001, "x\r\ny z", ""), (None, "u", "y" * 1500), (9002, "u", "y" * 1500), (9003, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 200), (9004, "u", "end\r\n" * 300), (9004, "u", "end\r\n" * 300), (9005, None, "z" * 500000)], p.schema)
    return p.union(p.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 5000)).union(odd)


def test_against_hand(spark):
    p = pages(spark)
    want = by_hand([tuple(r) for r in p.select("page_id", "url", "html").collect()])
    got = warc.op10_warc(p.withColumn("record_type", F.lit(1)).withColumn("payload", F.lit(2)))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert warc.op10_warc(p.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    p = pages(spark).filter("page_id IS NOT NULL").dropDuplicates(["page_id"])
    warc.write_archives(warc.resolve(p), str(tmp_path / "w"))
    back = {r.page_id: bytes(r.payload or b"") for r in warc.restore(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert back == {r.page_id: (r.html or "").encode() for r in p.collect()}


def test_shuffle_join_agrees(spark, monkeypatch):
    p = pages(spark)
    want = Counter(map(tuple, warc.op10_warc(p).collect()))
    for most in (0, 3):
        monkeypatch.setattr(warc, "SMALL", most)
        assert Counter(map(tuple, warc.op10_warc(p).collect())) == want


def test_bitmap_marks_every_group(spark):
    rows = spark.range(3000).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("d"), "id")
    groups = rows.filter("id % 10 = 0").select("d")
    marked = warc._marked(rows, "d", groups, 300, "b", "m").collect()
    assert all(r.m for r in marked if r.id % 10 == 0) and sum(r.m for r in marked) < 600 and len(marked) == 3000


def test_damage_is_seen():
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:newsgrid:page:1>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse_lines(iter(head.split("\r\n")[:-1])))
    with pytest.raises(ValueError):
        list(warc.parse_lines(iter(["HTTP"])))
