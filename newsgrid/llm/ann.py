"""Approximate nearest neighbours by multi-index hashing.

Model: the vectors' mean, principal axes and several learned rotations (each turned, from its own start, to bring the
projected vectors near the corners of a cube), fitted on a bounded sample.  A vector's code is one sign bit for each
rotated axis, cut into substrings of about log2(n) bits.

Index: the distinct vectors lie in shards, and in a shard every substring number has a table from its values to vectors.
A query probes each table with all values within its radius, so by the pigeonhole rule every code within the Hamming
radius R is retrieved: with m substrings and R = m*r + a, two codes within R agree up to r bits in one of the first a+1
substrings, or up to r-1 bits in one of the others.  What is retrieved is checked by the distance of whole codes, then
reranked by the vectors themselves.  Codes are made once, and every vector is shuffled once, to its shard: a task holds
one shard, of bounded size, builds its tables once and takes the queries in turn, so no pairs of queries and vectors
leave it.  Queries come to all shards in broadcasts of bounded size, and each broadcast is one pass over the shards.

R, the number of substrings in use and the bound on whole codes are set so that they cover a share of the true
neighbours of a bounded set of trial queries, which are compared with all vectors once.  Queries that end with fewer
than k neighbours are compared with all vectors, so nothing is lost to the radius there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import checkpointed, col

#: Numbers of substrings that are tried; the largest is what codes hold.
TABLES = (32, 64, 128)
#: Rows at most that the rotations are fitted on, trial queries at most, queries at most that are compared with all vectors at a time.
FIT_ROWS, TRIALS, BLOCK = 8192, 128, 4096
#: Shares of the trials' true neighbours that the probes and the bound on whole codes cover.
RETRIEVED, WITHIN = 0.96, 0.99
#: Vectors in a shard, about; queries whose hits are marked at a time; shards at least, so that all cores have work.
SHARD, QUERIES, LEAST_SHARDS = 32768, 1024, 12
#: Bytes of query vectors in a broadcast, about.
SENT = 1 << 25
#: Substrings of so many bits at most have a table of starts, longer ones are searched for.
DIRECT = 15


class Codes:
    """The fitted model: mean and projection (dims x tables*sub)."""

    def __init__(self, sample: np.ndarray, tables: int, sub: int, rounds: int = 15, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.sub, bits = tables, sub, tables * sub
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        low, k, parts = centred @ axes, axes.shape[1], []
        for _ in range(-(-bits // k)):
            turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
                turn = (u @ vt).T
            parts.append(axes @ turn)
        self.projection = np.concatenate(parts, axis=1)[:, :bits]

    def substrings(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of substrings, each a number of `sub` bits."""
        out = np.empty((len(vectors), self.tables), dtype=np.int32)
        weights = (1 << np.arange(self.sub)).astype(np.float64)
        for i in range(0, len(vectors), 2048):
            signs = (vectors[i : i + 2048] - self.mean) @ self.projection > 0
            out[i : i + 2048] = signs.reshape(-1, self.tables, self.sub) @ weights
        return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, substring by substring."""
    return np.bitwise_count((a ^ b).astype(np.uint32)).astype(np.int32)


def reach(differing: np.ndarray) -> np.ndarray:
    """The least radius R that retrieves a code whose substrings differ by so many bits (last axis: the substrings)."""
    m = differing.shape[-1]
    return (m * differing + np.arange(m)).min(axis=-1)


def radii(radius: int, tables: int) -> list[int]:
    """The radius of each substring, -1 where it is not probed."""
    r, a = divmod(radius, tables)
    return [r if j <= a else r - 1 for j in range(tables)]


def ball(sub: int, radius: int) -> list[int]:
    """All numbers of `sub` bits with up to `radius` of them set, the fewest first."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(sub), n)]


def _ball_size(sub: int, radius: int) -> int:
    return sum(math.comb(sub, n) for n in range(radius + 1))


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths, without nulls, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(x: Column, dims: int) -> Column:
    number = lambda v: v.cast("double")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(number(v)) & (F.abs(number(v)) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return (F.size(x) == dims) & F.coalesce(good, F.lit(False))


def _encode(model: Codes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.substrings(_matrix(batch.column(1)))
            offsets = pa.array(np.arange(0, codes.size + 1, model.tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["id", "code"])

    return run


def compare_all(points: DataFrame, queries: list, model: Codes, k: int) -> DataFrame:
    """(query_id, vec_id, score, differing): the k nearest rows of each of a block of queries (id, vector), by comparing them
    with all points (x, ids); each task keeps the k best of each query.  differing: bits by substring."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((model, np.array([r[0] for r in queries], dtype=np.int64), np.array([r[1] for r in queries], dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, q_ids, q_vectors = shared.value
        q_codes = model.substrings(q_vectors)
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, model.tables), np.int32))
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            x = _matrix(batch.column(0))
            codes = model.substrings(x)
            # rows of each point: its ids, as often as they are there (k times at most)
            entries = [(i, e["vec_id"]) for i, ids in enumerate(batch.column(1).to_pylist()) for e in ids for _ in range(min(k, e["copies"]))]
            of, ids = (np.array(c, dtype=np.int64) for c in zip(*entries))
            for lo in range(0, len(q_ids), 64):
                some = q_vectors[lo : lo + 64]
                score = np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in some])[:, of]
                score[q_ids[lo : lo + 64, None] == ids[None, :]] = np.inf
                take = np.argpartition(score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
                # ties at the k-th place go to the smaller id, so all entries up to its score count
                edge = np.take_along_axis(score, take, axis=1).max(axis=1)
                q, e = np.nonzero((score <= edge[:, None]) & np.isfinite(score))
                got = (q + lo, score[q, e], ids[e], apart(q_codes[q + lo], codes[of[e]]))
                best = _best(*(np.concatenate(p) for p in zip(best, got)), k)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[2]), pa.array(best[1]), pa.array(best[3].tolist(), pa.list_(pa.int32()))], names=["query_id", "vec_id", "score", "differing"])

    found = points.select("x", "ids").mapInArrow(run, "query_id long, vec_id long, score double, differing array<int>")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, extra: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, score, q))
    q, score, ids, extra = q[order], score[order], ids[order], extra[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
    return q[keep], score[keep], ids[keep], extra[keep]


def fit(sample: np.ndarray, queries: np.ndarray, differing: np.ndarray, model: Codes, n: int, n_queries: int) -> tuple[int, int, int]:
    """(tables, radius, bound): for each number of substrings the radius that covers RETRIEVED of the trials' neighbours
    (differing: theirs), of which the cheapest is taken: index rows, probes and retrieved rows."""
    q_codes, codes, found = model.substrings(queries), model.substrings(sample[:1024]), []
    for m in (t for t in TABLES if t <= model.tables):
        radius = int(np.quantile(reach(differing[:, :m]), RETRIEVED, method="higher"))
        bound = int(np.quantile(differing[:, :m].sum(axis=1), WITHIN, method="higher"))
        share = np.mean([(reach(apart(codes[:, :m], c[:m])) <= radius).mean() for c in q_codes])
        probes = sum(_ball_size(model.sub, r) for r in radii(radius, m))
        found.append((n * m + n_queries * (probes * max(1, n / SHARD) + share * n), m, radius, bound))
    return min(found)[1:]


class Tables:
    """The substring tables of a shard: for each substring in use the order of its values and where each value starts."""

    def __init__(self, codes: np.ndarray, sub: int, radius: int) -> None:
        self.n, self.sub, self.radii = len(codes), sub, [r for r in radii(radius, codes.shape[1]) if r >= 0]
        self.masks = np.array(ball(sub, self.radii[0]) if self.radii else [], dtype=np.int32)
        self.orders, self.values, self.starts = [], [], []
        for j in range(len(self.radii)):
            order = np.argsort(codes[:, j], kind="stable").astype(np.int32)
            values = codes[order, j]
            self.orders.append(order)
            self.values.append(values)
            self.starts.append(np.searchsorted(values, np.arange((1 << sub) + 1)).astype(np.int32) if sub <= DIRECT else None)

    def retrieve(self, asked: np.ndarray) -> np.ndarray:
        """(queries x vectors) whether the probes of a query's substrings meet the vector: all codes within the radius, and
        others."""
        hit = np.zeros((len(asked), self.n), dtype=bool)
        for j, r in enumerate(self.radii):
            order, values, starts = self.orders[j], self.values[j], self.starts[j]
            mine = self.masks[: _ball_size(self.sub, r)]
            for lo in range(0, len(asked), 256):
                wanted = asked[lo : lo + 256, j, None] ^ mine[None, :]
                if starts is None:
                    first, stop = np.searchsorted(values, wanted, side="left"), np.searchsorted(values, wanted, side="right")
                else:
                    first, stop = starts[wanted], starts[wanted + 1]
                n = stop - first
                q, probe = np.nonzero(n)
                first, n = first[q, probe], n[q, probe]
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                hit[lo + np.repeat(q, n), order[at]] = True
        return hit


def retrieve(codes: np.ndarray, asked: np.ndarray, sub: int, radius: int) -> np.ndarray:
    """What the probes of `asked` meet among codes."""
    return Tables(codes, sub, radius).retrieve(asked)


def _search(model: Codes, sent: object, tables: int, radius: int, bound: int, k: int) -> Callable:
    """A partition of points (x, ids, code) is a shard -> the k best entries there of each query that was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = [b for b in batches if b.num_rows]
        q_ids, y, q_codes = sent.value
        if not shard:
            return
        points = pa.Table.from_batches(shard)
        x = _matrix(points.column("x").combine_chunks())
        codes = _matrix(points.column("code").combine_chunks()).astype(np.int32)[:, :tables]
        ids, index = points.column("ids").combine_chunks(), Tables(codes, model.sub, radius)
        types = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        for lo in range(0, len(q_ids), QUERIES):
            out: list[tuple] = []
            asked = q_codes[lo : lo + QUERIES, :tables]
            hit = index.retrieve(asked)
            for i in range(len(asked)):
                rows = np.flatnonzero(hit[i])
                rows = rows[apart(asked[i], codes[rows]).sum(axis=1) <= bound]
                d = x[rows] - y[lo + i]
                score = np.sqrt((d * d).sum(axis=1))
                if len(rows) > k:  # all points up to the score of the k-th may give an entry
                    near = score <= np.partition(score, k - 1)[k - 1]
                    rows, score = rows[near], score[near]
                entries = sorted((s, e["vec_id"], e["copies"]) for r, s in zip(rows.tolist(), score.tolist()) for e in ids[r].as_py())
                out += [(int(q_ids[lo + i]), *e) for e in entries[:k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["q", "score", "vec_id", "copies"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """The k nearest rows of `vectors` for each row of `queries`: query_id, rank, vec_id, score (Euclidean, double).

    Both have columns vec_id and embedding (array of numbers).  Rows whose vec_id is null, or whose vector is null,
    zero, of another length than most of the sample, or holds null or non-finite parts, take no part.  A row is never
    its own query's neighbour; rows with a query's vec_id are not either.  Query rows that repeat a vec_id are one
    query (the least vector).  Repeated candidate rows are candidates each.  Ties go to the smaller vec_id.

    Equal vectors are one point of the index with the k+1 smallest ids, and one query, however many rows they have.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = lambda t: t.select(col("vec_id").cast("long").alias("vec_id"), col("embedding").alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    known, queries = rows(vectors), rows(queries)
    whole = F.size("x") > 0
    lengths = known.filter(whole & _usable(F.col("x"), F.size("x"))).select(F.xxhash64(F.lit(seed), "vec_id").alias("h"), "vec_id", F.size("x").alias("n")).orderBy("h", "vec_id").limit(FIT_ROWS).groupBy("n").count().collect()
    if not lengths:
        return empty
    dims = max((r["count"], r["n"]) for r in lengths)[1]
    good = _usable(F.col("x"), dims)
    same = known.filter(good).groupBy("x", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    least = same.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    points = least.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("vec_id", "copies"))).alias("ids"))  # k + 1 at most
    points = checkpointed(points.withColumn("v", F.monotonically_increasing_id()))
    links = queries.filter(good).groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = checkpointed(links.select("x").distinct().withColumn("q", F.monotonically_increasing_id()))
    links = checkpointed(links.join(asked, "x").select(F.col("vec_id").alias("query_id"), "q"))
    n, n_queries = points.count(), asked.count()
    if not n or not n_queries:
        return empty
    some = lambda t, most: t.orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(most)
    sample = np.array([r["x"] for r in some(points.select("x"), FIT_ROWS).collect()], dtype=np.float64)  # bounded: FIT_ROWS rows
    model = Codes(sample, max(TABLES), max(6, min(20, round(math.log2(n)))), seed=seed)
    trials = some(asked.join(links, "q"), TRIALS).select("query_id", "x").collect()  # bounded: TRIALS rows
    true = compare_all(points, trials, model, k).select("differing").collect()
    if not true:
        return empty
    tables, radius, bound = fit(sample, np.array([r["x"] for r in trials], dtype=np.float64), np.array([r[0] for r in true]), model, n, n_queries)
    coded = points.join(points.select("v", "x").mapInArrow(_encode(model), "id long, code array<int>").withColumnRenamed("id", "v"), "v")
    index = checkpointed(coded.select("x", "ids", "code").repartition(max(LEAST_SHARDS, -(-n // SHARD))))
    part = lambda c, seed_, parts: F.pmod(F.xxhash64(F.lit(seed_), c), F.lit(parts)).cast("int")
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    passes, tops = -(-n_queries * dims * 8 // SENT), []
    for b in range(passes):
        block = asked.filter(part("q", seed + 4, passes) == b).collect()  # about SENT bytes of vectors
        if not block:
            continue
        y = np.array([r["x"] for r in block], dtype=np.float64)
        sent = spark.sparkContext.broadcast((np.array([r["q"] for r in block], dtype=np.int64), y, model.substrings(y)))
        near = index.mapInArrow(_search(model, sent, tables, radius, bound, k + 1), "q long, score double, vec_id long, copies long")
        best = near.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id", "copies"))).alias("near"))  # k + 1 at most
        tops.append(checkpointed(best))
    top = reduce(DataFrame.union, tops)
    other = F.filter("near", lambda e: e["vec_id"] != F.col("query_id"))
    each = F.slice(F.flatten(F.transform(other, lambda e: F.array_repeat(F.struct(e["vec_id"].alias("vec_id"), e["score"].alias("score")), F.least(e["copies"], F.lit(k)).cast("int")))), 1, k)
    found = checkpointed(links.join(top, "q", "left").select("query_id", "q", F.coalesce(each, F.array().cast("array<struct<vec_id:bigint,score:double>>")).alias("near")))
    out = found.filter(F.size("near") == k).select("query_id", F.posexplode("near").alias("rank", "e")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")
    short = checkpointed(found.filter(F.size("near") < k).select("query_id", "q").join(asked, "q").select("query_id", "x"))
    turns = -(-short.count() // (BLOCK // 2))
    for b in range(turns):
        block = short.filter(part("query_id", seed + 5, turns) == b).collect()  # about BLOCK / 2 queries
        if block:
            out = out.union(checkpointed(compare_all(points, block, model, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")))
    return out


def op6_ann(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every vector whose vec_id is divisible by 100, among all others."""
    return nearest(vectors, vectors.filter(col("vec_id") % 100 == 0))
