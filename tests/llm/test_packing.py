import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from newsgrid.llm import packing
from tests.conftest import SMALL


def held(rows, texts):
    """Every id of every document in exactly one piece, sequences without gaps or overflow."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(d), zlib.crc32(np.array(ids[s : s + 2048], dtype="<u4").tobytes()), s, len(ids[s : s + 2048]), len(ids)) for d, t in texts for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [1]] for s in range(0, len(ids), 2048))
    assert want == sorted((str(r.doc_id), r.ids_crc32, r.start, r.length, r.doc_tokens) for r in rows)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert sorted(sequences) == list(range(len(sequences))) and all(n <= 2048 for n in sequences.values())
    return sum(sequences.values()) / 2048 / max(1, len(sequences))


def test_against_tokenizer(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert held(packing.op4_packing(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()]) > 0.95


def test_odd_tables(spark, odd, none):
    tricky = spark.createDataFrame([(20, "Ünï  İSTANBUL ΣΑΣ. a,b c.,d. it's <|endoftext|>. ﬁ x<|startoftext|>y 3.14, don't. \x0b\x0c A你好, ."), (21, None)], "doc_id long, text string")
    both = odd.select("doc_id", "text").union(tricky)
    held(packing.op4_packing(both).collect(), [(r.doc_id, r.text) for r in both.collect()])
    assert packing.op4_packing(none).count() == 0


def test_histogram():
    for h in ({}, {1: 5000}, {2048: 3, 1024: 5, 1: 1}, {i: 2048 - i for i in range(1, 2048)}):
        patterns = packing.pack_histogram(dict(h))
        used = {}
        for pattern, n in patterns:
            assert n > 0 and sum(s * t for s, t in pattern) <= 2048
            for s, t in pattern:
                used[s] = used.get(s, 0) + t * n
        assert used == h


def test_ids(spark):
    docs = spark.createDataFrame([(1, "Hello, world. " * 900)], "doc_id long, text string")
    rows = packing.tokenize(docs, keep_ids=True).orderBy("start").collect()
    assert sum((r.ids for r in rows), [])[-1] == 1 and all(len(r.ids) == r.length for r in rows)
