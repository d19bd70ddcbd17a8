"""State between runs and in streams against batch versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsgrid.operators import rank, state
from newsgrid.streaming import jobs

ROWS = "batch int, event_id string, first_seen_s long, last_seen_s long, aliases array<string>, item_id string, source_id string"


def batches(seed):
    """Random clusters over six batches that share items, ids and aliases."""
    rng, out = random.Random(seed), []
    for n in range(6):
        items = [f"i{k}" for k in range(40)]
        rng.shuffle(items)
        for c in range(rng.randrange(3, 9)):
            mine, at = [items.pop() for _ in range(rng.randrange(1, 4))], 1000 * n + rng.randrange(900)
            aliases = [f"e{rng.randrange(25)}" for _ in range(rng.randrange(3))]
            out += [(n, f"e{rng.randrange(25)}x{c}" if rng.random() < 0.5 else f"e{c + 10 * (n % 2)}", at, at + 50, aliases, i, f"s{rng.randrange(5)}") for i in mine]
    ids, rows = {}, []
    for r in out:  # one set of aliases and bounds for an id of a batch
        rows.append((*r[:2], *ids.setdefault(r[:2], r[2:5]), *r[5:]))
    return rows


def test_partitioned_state_is_the_whole_state(spark, tmp_path):
    """Batches that touch some partitions give what updates of the whole state give, and a repeated batch changes nothing."""
    for seed, buckets in ((1, 64),):
        rows = batches(seed)
        now = lambda n: 1000 * n + 1000
        stream = jobs.land(spark.createDataFrame(rows, ROWS), "batch")
        held = jobs.stream_state(stream.drop("batch"), str(tmp_path / f"state{seed}"), now, 3000 / 86400, buckets=buckets)
        prev = spark.createDataFrame([], "event_id string, version int, aliases array<string>, first_seen_s long, last_seen_s long")
        members = spark.createDataFrame([], "event_id string, item_id string, source_id string")
        seen = set()
        for n in range(6):
            batch = spark.createDataFrame([r for r in rows if r[0] == n], ROWS)
            new = batch.groupBy("event_id").agg(F.min("first_seen_s").alias("first_seen_s"), F.max("last_seen_s").alias("last_seen_s"), F.first("aliases").alias("aliases"))
            mine = batch.select("event_id", "item_id", "source_id").distinct()
            nxt = jobs.checkpointed(state.update_state(new, mine, prev, members, now(n), 3000 / 86400))
            fresh = nxt.filter("origin IS NOT NULL").select("event_id", "origin").join(mine.withColumnRenamed("event_id", "origin"), "origin").select("event_id", "item_id", "source_id")
            members = jobs.checkpointed(fresh.union(members.join(nxt.filter("origin IS NULL").select("event_id"), "event_id", "left_semi")).distinct())
            prev = nxt
            row = lambda r: (r.event_id, r.status, r.version, tuple(r.aliases), r.first_seen_s, r.last_seen_s)
            assert sorted(map(row, held.clusters(n).collect())) == sorted(map(row, nxt.collect()))
            assert sorted(map(tuple, held.members(n).collect())) == sorted(map(tuple, members.collect()))
            seen |= {r.status for r in nxt.collect()}
        assert seen == {"new", "updated", "unchanged"}
        before = held.manifest(5)
        assert held.apply(new, mine, 5, now(5)) is False and held.manifest(5) == before
        assert len({at for at, _ in before.values()}) > 1  # some partitions are those of earlier batches


def test_source_joins_anew_after_expiry(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = [(0, 1, "a", day(0)), (0, 2, "a", day(0)), (1, 1, "a", day(5)), (1, 1, "b", day(5)), (2, 9, "z", day(20)), (3, 2, "a", day(21)), (3, 1, "a", day(21)), (4, 9, "z", day(60)), (5, 1, "a", day(61)), (5, 1, "c", day(61))]
    stream = jobs.land(spark.createDataFrame(rows, "batch int, cluster_id long, source_id string, published_at timestamp"), "batch")
    out = jobs.with_rocksdb(lambda: jobs.stream_source_sets(stream, "18 days"), spark)
    # cluster 2 was last heard of on day 0 and is forgotten by day 20; cluster 1, on day 5, is not
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "a"), (9, "z")]


def test_exact_spans_in_the_stream(spark):
    rng = random.Random(4)
    rows = [(n, rng.randrange(12), datetime(2024, 1, 1) + timedelta(hours=6 * n, seconds=rng.randrange(40000))) for n in range(8) for _ in range(12)]
    df = spark.createDataFrame(rows, "batch int, cluster_id long, published_at timestamp")
    out = jobs.with_rocksdb(lambda: jobs.stream_tight_spans(jobs.land(df, "batch"), 3, "1 day"), spark)
    got = {r.cluster_id: (r.x.span, r.x.two) for r in out.groupBy("cluster_id").agg(F.max_by(F.struct("span", "two"), "n").alias("x")).collect()}
    want = {r.cluster_id: (r.span, r.two) for r in rank.tight_spans(df, 3).collect()}
    close = lambda a, b: a == b or a is not None and b is not None and abs(a - b) < 1e-6
    assert set(got) == set(want) and all(close(*p) for k in want for p in zip(got[k], want[k]))


def test_breaking_counts_publishers_exactly(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [(0, 1, f"s{k % 3000}", at(1)) for k in range(4000)] + [(0, 1, None, at(1)), (0, 2, "a", at(1)), (0, 2, "b", at(1)), (0, 3, "a", at(1)), (0, 3, "a", at(1)), (1, 9, "z", datetime(2024, 1, 3))]
    stream = jobs.land(spark.createDataFrame(rows, "batch int, cluster_id long, source_id string, published_at timestamp"), "batch")
    out = jobs.run_to_table(jobs.stream_breaking(stream.drop("batch"), 2, "1 hour", "1 hour"))
    assert sorted((r.cluster_id, r.n_publishers) for r in out.collect()) == [(1, 3000), (2, 2)]


def test_sources_of_a_cluster_are_one_value():
    """however many sources a cluster has, a batch reads its state once and writes it once."""
    import pandas as pd

    from newsgrid.streaming.jobs import SourceSets

    class Value:
        held, calls = None, 0

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls, self.held = self.calls + 1, value

    class Handle:
        value, timers = Value(), set()

        def getValueState(self, name, schema):
            return self.value

        def registerTimer(self, ms):
            self.timers.add(ms)

        def deleteTimer(self, ms):
            self.timers.remove(ms)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    job, handle = SourceSets(1000), Handle()
    job.init(handle)
    part = lambda ids, ms: pd.DataFrame({"source_id": ids, "published_at": pd.to_datetime(ms, unit="ms")})
    first = pd.concat(job.handleInputRows((1,), iter([part(["a", "b", "a"], [5, 9, 7])]), Times()))
    assert list(first["source_id"]) == ["a", "b"] and handle.value.calls == 2 and handle.timers == {1009}
    assert [list(p["source_id"]) for p in job.handleInputRows((1,), iter([part(["b", "c"], [8, 3])]), Times())] == [["c"]]
    assert handle.value.calls == 4 and handle.timers == {1009} and sorted(handle.value.held[1]) == ["a", "b", "c"]
