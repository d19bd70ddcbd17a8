import re
from collections import defaultdict

import numpy as np

from newsgrid.llm import mixing
from newsgrid.llm.mixing import draw_rows, mix, mixing_stage, op1_mixing, share, split_quotas, write_mix
from tests.conftest import SMALL


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared_by_hand(sizes, weights, most=3):
    """Lift a water level until the parts add up to the whole."""
    total, lo, hi = sum(sizes), 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(most * s, mid * w) for s, w in zip(sizes, weights)) < total:
            lo = mid
        else:
            hi = mid
    return [min(most * s, hi * w) for s, w in zip(sizes, weights)]


def held(rows, got):
    size = defaultdict(int)
    for _, source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, shared_by_hand([size[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    taken = defaultdict(int)
    for (_, source, n), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], r["source"], r["size"])))):
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-3 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 1


def run(spark, docs):
    rows = [(r.doc_id, r.source, words(r.text)) for r in docs.collect()]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mix(sized, ["doc_id"])
    held(rows, got.collect())
    return got


def test_against_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = run(spark, docs)
    again = {r.doc_id: r.taken for r in op1_mixing(docs).collect()}
    assert again == {r.doc_id: r.taken for r in got.collect()} == {r.doc_id: r.taken for r in op1_mixing(docs.repartition(7)).collect()}
    uses = draw_rows(got)
    assert {r.doc_id: r.n for r in uses.groupBy("doc_id").agg({"words": "sum"}).withColumnRenamed("sum(words)", "n").collect()} == {k: v for k, v in again.items() if v}


def test_odd_tables(spark, odd, none):
    run(spark, odd)
    assert op1_mixing(odd).count() == 14 and op1_mixing(none).count() == 0
    assert mixing_stage(odd).columns == odd.columns and mixing_stage(none).count() == 0


def test_shares_and_tree():
    assert share([0, 0], [1, 2], 0, 3) == [0, 0]
    assert np.allclose(share([10, 1000], [3, 1], 1010, 3), [30, 980])
    q = split_quotas([5, 0, 1000, 37], 16, 1)
    assert q.sum(axis=0).tolist() == [5, 0, 1000, 37] and q.sum(axis=1).max() - q.sum(axis=1).min() <= 1 and (q >= 0).all()


def test_whole_documents_keep_near_target(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sized = spark.createDataFrame([(r.doc_id, r.source, words(r.text)) for r in docs.collect()], "doc_id long, source string, size long")
    got = mix(sized, ["doc_id"], cut=False).collect()
    biggest = max(r["size"] for r in got)
    by = defaultdict(list)
    for r in got:
        assert r["taken"] % max(r["size"], 1) == 0
        by[r["source"]].append(r)
    assert all(abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= biggest for rows in by.values())


def test_whole_documents_fill_every_source(spark):
    """A document beyond the rest of its target is passed over for those that fit, wherever it stands in the order."""
    for seed in range(3):
        rows = [(i, "a", 500) for i in range(200)] + [(200, "a", 100_000), (300, "b", 400_000), (301, "c", 40)] + [(400 + i, "d", 700) for i in range(100)]
        sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
        got = mix(sized, ["doc_id"], weights=(3, 1, 1, 4), share_of_all=0.25, cut=False, seed=seed).collect()
        by = defaultdict(list)
        for r in got:
            assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
            assert all(0 <= d["shard"] < 16 for d in r["draws"])
            by[r["source"]].append(r)
        for source, gap in (("a", 500), ("c", 40), ("d", 700)):
            assert abs(sum(r["taken"] for r in by[source]) - by[source][0]["target"]) < gap
        assert by["b"][0]["taken"] == 400_000


def test_tree_law():
    """Over many seeds a shard's blocks of a source have the mean and variance of a multivariate hypergeometric draw."""
    quotas, shards, runs = [40, 24, 64], 8, 2000
    draws = np.array([split_quotas(quotas, shards, seed) for seed in range(runs)])
    total, room = sum(quotas), sum(quotas) // shards
    for k, q in enumerate(quotas):
        p = q / total
        var = room * p * (1 - p) * (total - room) / (total - 1)
        for shard in range(shards):
            x = draws[:, shard, k]
            assert abs(x.mean() - room * p) < 5 * np.sqrt(var / runs) and abs(x.var() - var) < 0.25 * var
    # two shards share no block: their covariance is that of drawing without replacement
    p = quotas[0] / total
    assert abs(np.cov(draws[:, 0, 0], draws[:, 5, 0])[0, 1] + room * room * p * (1 - p) / (total - 1)) < 0.2


def test_blocks_are_disjoint(spark):
    """Every block of a source's stream goes to one shard, the tree's number of them, and positions have no gaps."""
    rows = [(i, f"s{i % 3}", 10) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mix(sized, ["doc_id"], shards=5, blocks=60)
    plan, _ = mixing.plan(sized.groupBy("source").agg({"size": "sum"}).toDF("source", "size"), (1, 2, 3), 1.0, 3, 5, 60, 42)
    quotas = [len(r.shards) for r in plan.orderBy("i").collect()]
    uses = draw_rows(mixed).collect()
    per_shard = defaultdict(list)
    for r in uses:
        per_shard[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in per_shard.values()) and len(per_shard) == 5
    got, block = np.zeros((5, 3)), 500
    for r in uses:
        got[r["shard"], int(r["source"][1])] += r["words"] / block
    assert np.abs(got - split_quotas(quotas, 5, 42)).max() <= 0.05  # documents of ten words cross the edges of blocks of 500


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sized = spark.createDataFrame([(r.doc_id, r.source, words(r.text)) for r in docs.collect()], "doc_id long, source string, size long")
    drawn = draw_rows(mix(sized, ["doc_id"], shards=4)).select("doc_id", "epoch", "shard", "position")
    write_mix(drawn, str(tmp_path / "mix"), 4)
    back = spark.read.parquet(str(tmp_path / "mix"))
    assert sorted(map(tuple, back.select(*drawn.columns).collect())) == sorted(map(tuple, drawn.collect()))
    for f in (tmp_path / "mix").rglob("*.parquet"):
        places = [r.position for r in spark.read.parquet(str(f)).collect()]
        assert places == sorted(places)
    got = op1_mixing(docs).collect()
    spots = [(s, p) for r in got for s, p in zip(r["shards"], r["positions"])]
    assert len(set(spots)) == len(spots) and all(p < len(spots) for _, p in spots)
    order = [p for _, p in sorted((d.doc_id, d.position) for d in drawn.collect() if d.shard == 0)]
    assert order != sorted(order)  # shuffled


def test_many_sources(spark, monkeypatch):
    """Beyond MAX_SOURCES the plan is made by Spark: the same targets, the same number of blocks, every word taken."""
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 97 == 0 else f"s{int(rng.integers(0, 400)):03d}" if i % 3 else "hot", int(rng.integers(0, 200))) for i in range(3000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    here = mix(sized, ["doc_id"])
    want = {r["doc_id"]: (r["source_size"], round(r["target"], 4), r["taken"]) for r in here.collect()}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 50)
    monkeypatch.setattr(mixing, "GROUP", 60)
    there = mix(sized, ["doc_id"])
    assert {r["doc_id"]: (r["source_size"], round(r["target"], 4), r["taken"]) for r in there.collect()} == want
    load = defaultdict(int)
    for r in draw_rows(there).collect():
        load[r["shard"]] += r["words"]
    assert len(load) == 16 and max(load.values()) < 1.4 * min(load.values())
    whole = mix(sized, ["doc_id"], cut=False).collect()
    assert {r["doc_id"] for r in whole} == set(want)


def test_stage_order_and_repeats(spark):
    """Repeated rows are drawn each for itself, and the stage's files hold shards in the order of positions."""
    text = lambda k: " ".join(f"w{k}" for _ in range(30))
    docs = spark.createDataFrame([(1, "a", text(1))] * 3 + [(2, "a", text(2)), (None, "b", text(3)), (None, "b", text(3)), (4, None, None)], "doc_id long, source string, text string")
    got = [tuple(r) for r in mixing_stage(docs).collect()]
    assert set(got) <= {(1, "a", text(1)), (2, "a", text(2)), (None, "b", text(3))}
    # 180 words by weights 1 and 2: two of a's four documents, whichever come first, and each of b's two rows twice
    assert sum(r[1] == "a" for r in got) == 2 and sum(r[1] == "b" for r in got) == 4


def test_stage_keeps_rows_that_differ_by_a_null_or_a_map_apart(spark):
    rows = [(1, "T", "en", None, {"a": 1}), (1, "T", None, "en", {"a": 1}), (2, "T", "en", None, {}), (2, "T", "en", None, {"a": None})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m map<string,int>")
    got = [(r.doc_id, r.text, r.lang, r.source, r.m) for r in mixing_stage(docs).collect()]
    assert all(g in rows for g in got) and (1, "T", None, "en", {"a": 1}) in got and any(g[3] is None for g in got)
