import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsgrid.llm import suffix_dedup as sd
from tests.conftest import SMALL


def by_hand(rows, length):
    """n_bytes, n_removed, n_spans and digest of each row, by a table of all strings of that length."""
    places = defaultdict(list)
    datas = [(t or "").encode() for _, t in rows]
    for i, d in enumerate(datas):
        for p in range(len(d) - length + 1):
            places[d[p : p + length]].append((i, p))
    gone = [np.zeros(len(d), dtype=bool) for d in datas]
    for where in places.values():
        for i, p in where if len(where) > 1 else ():
            gone[i][p : p + length] = True
    out = []
    for (doc_id, _), d, g in zip(rows, datas, gone):
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1))
        out.append((doc_id, len(d), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, dtype=np.uint8)[~g])).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def digests(df):
    return Counter((r.doc_id, r.n_bytes, sum(x.e - x.s for x in r.runs), len(r.runs), r.sha256 if r.kept is None else hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def patched(rng, n, letters="abcdeé"):
    """Texts made of shared passages with own words between, and edited copies."""
    say = lambda k: "".join(rng.choice(list(letters), k))
    passages = [say(int(k)) for k in rng.integers(20, 160, 6)]
    out = []
    for _ in range(n):
        text = "".join(passages[int(rng.integers(6))] if rng.random() < 0.6 else say(int(rng.integers(1, 50))) for _ in range(int(rng.integers(1, 8))))
        if out and rng.random() < 0.3:
            text = out[int(rng.integers(len(out)))]
            i = int(rng.integers(len(text)))
            text = text[:i] + say(int(rng.integers(0, 3))) + text[i + int(rng.integers(0, 3)) :]
        out.append(text)
    return out


@pytest.mark.parametrize("hot, group", [(10**6, 10**6), (64, 3), (10**6, 3)])
def test_against_all_strings(spark, hot, group):
    rng = np.random.default_rng(hot % 1000 + group)
    texts = [*patched(rng, 400), None, "", "a" * 39, "a" * 40, "a" * 41, "a" * 700, "ab" * 300, *["twice " * 9] * 2, *["short"] * 3, "é" * 20, "é" * 19 + "e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    want = by_hand(rows, 40)
    assert sum(0 < r[2] < r[1] for r in want) > 50 and sum(r[3] > 1 for r in want) > 20
    assert digests(sd.remove_repeats(docs, length=40, gram=12, hot=hot, group=group)) == want


def test_segments(spark, monkeypatch):
    """Units that end with a segment lose nothing."""
    monkeypatch.setattr(sd, "SEGMENT", 64)
    rng = np.random.default_rng(5)
    texts = patched(rng, 60)
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    doc, _, _, p, _, w = sd.units(np.frombuffer(b"".join(data), dtype=np.uint8), offsets, 40, 12)
    seen = Counter((d, x) for d, a, b in zip(doc.tolist(), p.tolist(), w.tolist()) for x in range(a, a + b + 1))
    assert seen == Counter((i, x) for i, d in enumerate(data) for x in range(len(d) - 39))


def test_deep_shallow_sorts():
    rng = np.random.default_rng(1)
    for trial in range(200):
        base = bytes(rng.integers(97, 100, 120).tolist())
        strings = [base[: int(rng.integers(0, 120))] + bytes(rng.integers(97, 100, int(rng.integers(0, 60))).tolist()) for _ in range(int(rng.integers(1, 60)))]
        order = sd.deep_shallow(strings, 0, (0, 8, 32)[trial % 3])
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)


def test_repeats_of_groups():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(2, 12))
        left = [bytes(rng.integers(97, 99, 12).tolist()) for _ in range(n)]
        right = [b"gram" + bytes(rng.integers(97, 99, 12).tolist()) for _ in range(n)]
        open_ = (rng.random(n) < 0.7).tolist()
        found = {(i, d) for i, a, b in sd.repeats(left, right, open_, 12, 4) for d in range(a, b + 1)}
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = {(i, d) for i in range(n) if open_[i] for j in range(n) if j != i for d in range(0, 9) if common(left[i], left[j]) >= d and common(right[i], right[j]) >= 12 - d}
        assert {(i, d) for i, d in found if 0 <= d <= 8} == want


def test_documents(spark, odd, none):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd):
        assert result(sd.op12_suffix_dedup(docs)) == by_hand([(r.doc_id, r.text) for r in docs.collect()], 400)
    assert sd.op12_suffix_dedup(none).count() == 0
