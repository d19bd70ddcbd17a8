import re
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

from newsgrid.llm import simhash
from tests.conftest import SMALL


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(rows):
    """Smallest doc_id that links of two bits or fewer reach."""
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(root(i), []).append(d)
    return [(d, f"{prints[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def test_against_hand(spark, odd, none):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op7_simhash(docs).collect()]
        assert Counter(got) == Counter(components(rows))
    assert simhash.op7_simhash(none).count() == 0


def test_crowded_blocks(spark):
    """A ball of fingerprints, far beyond the crowd that is joined as it is."""
    rng = np.random.default_rng(3)
    points = {0x123456789ABCDEF0, 0}
    for _ in range(600):
        p = 0x123456789ABCDEF0
        for b in rng.integers(0, 64, int(rng.integers(1, 5))):
            p ^= 1 << int(b)
        points.add(p)
    points |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    signed = [simhash._signed(p) for p in points]
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for crowd in (1, 8, 64):
        assert {(r.a, r.b) for r in simhash.near_pairs(df, crowd=crowd).collect()} == want
