import numpy as np

from newsgrid.llm import ann
from tests.conftest import SMALL


def by_hand(ids, x, k=10):
    out = {}
    for i in sorted(set(ids[ids % 100 == 0].tolist())):
        q = x[np.flatnonzero(ids == i)[0]]
        other = ids != i
        d = np.sqrt(((x[other] - q) ** 2).sum(axis=1))
        order = np.lexsort((ids[other], d))[:k]
        out[i] = (ids[other][order], d[order])
    return out


def test_recall_and_scores(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = v.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    want, hits, total = by_hand(ids, x), 0, 0
    got = ann.op6_ann(v).collect()
    for i, (near, dist) in want.items():
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r.score == np.sqrt(((x[ids == r.vec_id][0] - x[ids == i][0]) ** 2).sum()) for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(near.tolist())), total + 10
    assert hits / total >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [0.5, 0.5]), (200, None), (300, [0.0, 0.0]), (2, [1.0, 0.5]), (0, [1.0, 0.0])]
    v = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, query_id int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.op6_ann(v).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 2, 0.5), (0, 4, 100, 0.707107), (100, 1, 1, 0.5), (100, 2, 2, 0.5), (100, 3, 2, 0.5), (100, 4, 0, 0.707107), (100, 5, 0, 0.707107)]
    assert ann.op6_ann(v.limit(0)).count() == 0
    assert ann.op6_ann(v.filter("vec_id IN (3, 4, 200)")).count() == 0


def test_pigeonhole_finds_every_code():
    """The probes of the substring tables find every code within the radius."""
    rng = np.random.default_rng(1)
    for tables, sub, radius in ((4, 8, 0), (4, 8, 3), (4, 8, 6), (6, 5, 11), (32, 12, 70)):
        codes, asked = (rng.integers(0, 1 << sub, (n, tables)).astype(np.int32) for n in (400, 300))
        codes[:12] = asked[:12] ^ 1
        codes[20:200, 0] = asked[0, 0]
        differing = ann.apart(asked[:, None], codes[None])
        met = ann.retrieve(codes, asked, sub, radius)
        direct, ann.DIRECT = ann.DIRECT, 0
        assert (met == ann.retrieve(codes, asked, sub, radius)).all()
        ann.DIRECT = direct
        assert (met == (ann.reach(differing) <= radius)).all() and met[differing.sum(axis=2) <= radius].all()


def test_most_vectors_are_pruned(spark):
    """In clustered vectors the probes meet few of all pairs, and recall holds."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(60, 32)), 50, axis=0) + 0.25 * rng.normal(size=(3000, 32))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    want, hits = by_hand(np.arange(3000), x), 0
    got = {}
    for r in ann.op6_ann(v).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[i] & set(near.tolist())) for i, (near, _) in want.items()) >= 0.9 * 10 * len(want)
    model = ann.Codes(x, max(ann.TABLES), 12)
    queries = [(int(i), x[i]) for i in range(0, 3000, 100)]
    points = spark.createDataFrame([(r.tolist(), [(i, 1)]) for i, r in enumerate(x)], "x array<double>, ids array<struct<vec_id:bigint,copies:bigint>>")
    true = np.array([r.differing for r in ann.compare_all(points, queries, model, 10).collect()])
    tables, radius, _ = ann.fit(x, np.array([q for _, q in queries]), true, model, 3000, 30)
    codes = model.substrings(x)[:, :tables]
    assert np.mean([(ann.reach(ann.apart(codes, codes[i])) <= radius).mean() for i, _ in queries]) < 0.2


def test_copies_and_short_queries(spark, monkeypatch):
    """Very many equal vectors are one point; queries that find too few are compared with all vectors, in blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[100:300] = x[0]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.op6_ann(v).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == list(range(100, 110)) and got[100] == [0, *range(101, 110)] and got[200] == [0, *range(100, 109)]
    monkeypatch.setattr(ann, "BLOCK", 2)
    monkeypatch.setattr(ann, "QUERIES", 1)
    monkeypatch.setattr(ann, "SENT", 64)
    monkeypatch.setattr(ann, "SHARD", 9)
    monkeypatch.setattr(ann, "WITHIN", 0.0)
    monkeypatch.setattr(ann, "RETRIEVED", 0.0)
    rows = {}
    for r in sorted(ann.op6_ann(v.filter("vec_id < 100 OR vec_id >= 300")).collect(), key=lambda r: (r.query_id, r["rank"])):
        rows.setdefault(r.query_id, []).append(r.vec_id)
    assert set(rows) == {0, 300} and all(len(set(r)) == 10 for r in rows.values())
