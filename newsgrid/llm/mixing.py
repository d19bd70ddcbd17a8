"""Mixing sources to target weights.

Targets come from a weight per source by sharing a word budget, never above `max_epochs` times a source's own size.
Each source's documents stand in a fixed pseudo-random order, repeated epoch after epoch; the first `target` words of
that stream are the source's part of the mix, cut into blocks.  A splitting tree draws, by the multivariate
hypergeometric law, how many blocks of each source every output shard gets; the blocks of a source are permuted and
each shard takes a run of them, disjoint from the others', and is shuffled by a key of its own.

Up to MAX_SOURCES sources are planned on the driver.  More are planned by Spark: the water level is found by sums over
all sources, the tree splits the quotas of groups of sources, and each group deals its blocks to the shards by its part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrid.llm.common import checkpointed, col, fresh, mark_of, prefix_sums, text_or_empty, without, word_count
from newsgrid.operators.rank import small

#: Sources up to this many are planned on the driver and sent to all tasks.
MAX_SOURCES = 100_000
#: Sources in a group, about, where there are more.
GROUP = 1000
ADDED = ("size", "source_size", "target", "taken", "draws")
PLAN = "source string, i long, size long, target double, whole long, block long, shards array<int>"


def share(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Share a budget by weight; no part above most times its size, the excess shared again until none is above."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] / total * left > most * sizes[i]]
        if not above:
            for i in open_:
                target[i] = weights[i] / total * left
            break
        for i in above:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in above)
        open_ = [i for i in open_ if i not in set(above)]
    return target


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources), drawn down a splitting tree; columns add up to quotas."""
    rng, n = np.random.default_rng(seed), sum(quotas)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    room = [n * (i + 1) // shards - n * i // shards for i in range(shards)]

    def go(part: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = part
            return
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(part, sum(room[lo:mid]), method="marginals") if len(part) else part
        go(left, lo, mid)
        go(part - left, mid, hi)

    go(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def deal(quotas: list[int], counts: np.ndarray, seed: list[int]) -> list[list[int]]:
    """The shard of each block of some sources, their blocks permuted; counts: blocks for each shard, as many as the quotas."""
    dealt = np.random.default_rng(seed).permutation(np.repeat(np.arange(len(counts)), counts))
    return [part.tolist() for part in np.split(dealt, np.cumsum(quotas)[:-1])] if len(quotas) else []


def _plan_here(found: list, weights: tuple[float, ...], share_of_all: float, most: int, shards: int, blocks: int, seed: int) -> list[tuple]:
    """Rows of PLAN for a list of rows (source, size)."""
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in found]
    targets = share(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share_of_all * sum(sizes), most)
    whole = [min(round(t), most * s) for t, s in zip(targets, sizes)]
    block = max(1, math.ceil(sum(whole) / blocks))
    quotas = [-(-w // block) for w in whole]
    parts = split_quotas(quotas, shards, seed)
    return [(r["source"], k, sizes[k], targets[k], whole[k], block, deal([quotas[k]], parts[:, k], [seed, k])[0]) for k, r in enumerate(found)]


def _plan_there(sources: DataFrame, n: int, weights: tuple[float, ...], share_of_all: float, most: int, shards: int, blocks: int, seed: int) -> DataFrame:
    """The same for any number of sources, as a table: source, size -> PLAN."""
    spark = sources.sparkSession
    # places in code-point order: inside each part of a sorted table, after the rows of the parts before
    parted = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    sums = sorted(parted.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    starts = np.cumsum([0, *[r["n"] for r in sums]]).tolist()
    offsets = spark.createDataFrame([(r["part"], s) for r, s in zip(sums, starts)], "part bigint, base bigint")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = parted.join(F.broadcast(offsets), "part").withColumn("i", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("w", weight)
    ranked = checkpointed(ranked.select("source", "size", "i", "w", (most * F.col("size")).cast("double").alias("top")))
    total, high = ranked.agg(F.sum("size"), F.max(F.col("top") / F.col("w"))).first()
    budget, low, high = share_of_all * float(total or 0), 0.0, float(high or 0)
    while high - low > 1e-12 * high:  # about 40 sums of doubles over the sources
        level = (low + high) / 2
        if level in (low, high):
            break
        low, high = (level, high) if ranked.agg(F.sum(F.least("top", F.col("w") * level))).first()[0] < budget else (low, level)
    full = F.col("top") <= F.col("w") * low
    filled, rest = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("top"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
    exact = (budget - filled) / rest if rest else 0.0
    target = F.when(full, F.col("top")).otherwise(F.least("top", F.col("w") * exact))
    planned = ranked.withColumn("target", target).withColumn("whole", F.least(F.rint("target").cast("long"), most * F.col("size")))
    block = max(1, math.ceil((planned.agg(F.sum("whole")).first()[0] or 0) / blocks))
    groups = max(1, n // GROUP)
    planned = checkpointed(planned.withColumn("block", F.lit(block).cast("long")).withColumn("quota", F.ceil(F.col("whole") / block).cast("long")).withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(groups))).drop("w", "top"))
    per_group = sorted(planned.groupBy("g").agg(F.sum("quota").alias("quota")).collect())  # a row for about GROUP sources
    counts = dict(zip([r["g"] for r in per_group], split_quotas([r["quota"] for r in per_group], shards, seed).T.tolist()))
    table = spark.createDataFrame([(g, c) for g, c in counts.items()], "g bigint, counts array<bigint>")

    def dealt(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        part["shards"] = deal(part["quota"].tolist(), np.asarray(part["counts"].iloc[0]), [seed, int(part["g"].iloc[0])])
        return part[["source", "i", "size", "target", "whole", "block", "shards"]]

    return planned.join(small(table), "g").groupBy("g").applyInPandas(dealt, PLAN)


def plan(sources: DataFrame, weights: tuple[float, ...], share_of_all: float, most: int, shards: int, blocks: int, seed: int) -> tuple[DataFrame, int]:
    """PLAN for a table source, size, n (its documents), with n, and the number of sources."""
    n = sources.count()
    args = (weights, share_of_all, most, shards, blocks, seed)
    if n <= MAX_SOURCES:
        rows = _plan_here(sources.collect(), *args)  # MAX_SOURCES rows at most
        return sources.sparkSession.createDataFrame(rows, PLAN), n
    return checkpointed(_plan_there(sources.select("source", "size"), n, *args)), n


def _with_plan(df: DataFrame, source: str, its: DataFrame, n: int, sources: DataFrame, named: dict[str, str]) -> DataFrame:
    """df with the columns of its plan, renamed by `named`.  Beyond MAX_SOURCES the sources with the most documents go to
    all tasks; each of the others has less than one in MAX_SOURCES of them, so the join that finds these has no hot key."""
    renamed = its.select(*[F.col(k).alias(v) for k, v in named.items()])
    on = lambda t: col(source).cast("string").eqNullSafe(col(named["source"]))
    if n <= MAX_SOURCES:
        return df.join(F.broadcast(renamed), on(renamed), "left").drop(named["source"])
    often = checkpointed(sources.orderBy(F.desc("n"), "source").limit(MAX_SOURCES).select(F.col("source").alias(named["source"])))
    here = col(named["source"]).eqNullSafe(F.col("_often"))
    names = often.select(col(named["source"]).alias("_often"))
    known = df.join(F.broadcast(renamed.join(F.broadcast(names), here, "left_semi")), on(renamed), "left")
    missing = col(named["i"]).isNull()
    rest = known.filter(missing).drop(*named.values()).join(renamed.join(F.broadcast(names), here, "left_anti"), on(renamed), "left")
    return known.filter(~missing).unionByName(rest).drop(named["source"])


def _fill(docs: DataFrame, rest: DataFrame, seed: int) -> DataFrame:
    """(i, p, at): whole documents of each source i that fill its r words, and where each stands in these words.

    docs: i, p (place in the source, unique) and n (words, above 0); rest: i, r, bare.  Documents are taken in order while
    they fit; one that does not fit is passed over, and the order is gone through again with the words that are left, until
    no document of any source fits.  At the end the smallest document left is added where this comes nearer to the target,
    or where a source marked bare would have none.  The rest falls below the size of a passed-over document with each pass.
    """
    state, open_, got, first = checkpointed(rest.select("i", "r", F.lit(0).cast("long").alias("used"))), docs, None, True
    while True:
        fitting = open_.join(small(state), "i").filter(F.col("n") <= F.col("r"))
        # the first pass goes by the places that are known; p is the running sum there
        summed = fitting.withColumn("s", F.col("p")) if first else prefix_sums(fitting, ["i"], ["p"], F.col("n"), "s", seed=seed)
        taken = checkpointed(summed.filter(F.col("s") + F.col("n") <= F.col("r")).select("i", "p", "n", (F.col("used") + F.col("s")).alias("at")))
        if not first and taken.isEmpty():
            break
        first = False
        got = taken.select("i", "p", "at") if got is None else got.union(taken.select("i", "p", "at"))
        moved = taken.groupBy("i").agg(F.sum("n").alias("w"))
        state = checkpointed(state.join(moved, "i", "left").select("i", (F.col("r") - F.coalesce("w", F.lit(0))).alias("r"), (F.col("used") + F.coalesce("w", F.lit(0))).alias("used")))
        open_ = checkpointed(open_.join(taken.select("i", "p"), ["i", "p"], "left_anti"))
    none = rest.filter("bare").select("i").join(got, "i", "left_anti").withColumn("bare", F.lit(True))
    least = open_.groupBy("i").agg(F.min(F.struct("n", "p")).alias("d")).join(state, "i").join(none, "i", "left")
    over = least.filter(F.coalesce("bare", F.lit(False)) | (F.col("d.n") < 2 * F.col("r")))
    return got.union(over.select("i", F.col("d.p").alias("p"), F.col("used").alias("at")))


def mix(df: DataFrame, order: list[str], size: str = "size", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), share_of_all: float = 1.0, max_epochs: int = 3, shards: int = 16, blocks: int = 1024, seed: int = 42, cut: bool = True) -> DataFrame:
    """df with source_size, target, taken and draws, an array with one struct (epoch, words, shard, key) per use.

    `size` is a column of non-negative counts (null: 0), `order` the columns that fix a document's place.  Sources
    stand in code-point order, null last, and take `weights` in turn.  cut=True: the last document of a source's
    stream is used up to the target exactly; cut=False: documents are used whole, one that does not fit is passed over
    for later ones that do (see _fill), and a source with a target of a word or more gives at least one.  Documents of
    size 0, and all documents of an empty source, are not drawn (taken 0, no draws).  Beyond MAX_SOURCES sources the targets
    are the same, but blocks are dealt by groups of sources, so a block can go to another shard than below.  Rows with equal order columns
    and size are interchangeable.  An empty table gives an empty one.  Input columns named like the added ones are replaced.
    """
    df = df.withColumn(size, F.coalesce(col(size).cast("long"), F.lit(0).cast("long")))
    df = without(df, *[a for a in ADDED if a != size.lower()])
    sources = checkpointed(df.groupBy(col(source).cast("string").alias("source")).agg(F.sum(col(size)).alias("size"), F.count(F.lit(1)).alias("n")))
    its, n = plan(sources, weights, share_of_all, max_epochs, shards, blocks, seed)
    named = dict(zip(("source", "i", "size", "target", "whole", "block", "shards"), fresh(df, "_source", "_i", "_size", "_target", "_whole", "_block", "_shards")))
    i, (before, at, some) = named["i"], fresh(df, "_before", "_at", "_some")
    known = _with_plan(df, source, its, n, sources, named)
    placed = prefix_sums(known.withColumn(i, F.coalesce(col(i), F.lit(-1))), [i], [*order, size], col(size), before, seed=seed)
    of = lambda f: col(named[f])
    if not cut:
        placed = checkpointed(placed)
        left = F.col("whole") - F.call_function("div", F.col("whole"), F.col("size")) * F.col("size")
        rest = its.filter("size > 0").select("i", left.alias("r"), ((F.col("whole") > 0) & (F.col("whole") < F.col("size"))).alias("bare"))
        extra = _fill(placed.filter(col(size) > 0).select(col(i).alias("i"), col(before).alias("p"), col(size).alias("n")), rest, seed)
        extra = extra.select(F.col("i").alias(i), F.col("p").alias(before), F.col("at").alias(at))
        placed = placed.withColumn(some, col(size) > 0).join(extra.withColumn(some, F.lit(True)), [i, before, some], "left").drop(some)

    def use(epoch: int) -> Column:
        start = F.lit(epoch).cast("long") * of("size") + col(before)
        left = of("whole") - start
        if cut:
            words = F.when(left > 0, F.least(col(size), left)).otherwise(F.lit(0).cast("long"))
        else:  # all documents in whole epochs, those of _fill in the one that the target ends in
            full = F.call_function("div", of("whole"), F.greatest(of("size"), F.lit(1).cast("long")))
            last = (F.lit(epoch) == full) & col(at).isNotNull()
            words = F.when((F.lit(epoch) < full) | last, col(size)).otherwise(F.lit(0).cast("long"))
            start = F.least(F.when(last, F.lit(epoch).cast("long") * of("size") + col(at)).otherwise(start), F.greatest(of("whole") - 1, F.lit(0).cast("long")))
        shard = F.element_at(of("shards"), (F.call_function("div", start, of("block")) + 1).cast("int"))
        key = F.xxhash64(F.lit(seed + 1), F.lit(epoch), *[col(c) for c in order], col(before))
        return F.when(words > 0, F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), shard.alias("shard"), key.alias("key")))

    drawn = placed.withColumn("draws", F.array_compact(F.array(*[use(e) for e in range(max_epochs)])))
    taken = F.aggregate(F.col("draws"), F.lit(0).cast("long"), lambda s, d: s + d["words"])
    return drawn.select(*[col(c) for c in df.columns], of("size").alias("source_size"), of("target").alias("target"), taken.alias("taken"), F.col("draws"))


def draw_rows(mixed: DataFrame) -> DataFrame:
    """One row per use of a document, with its epoch, words, shard and shuffle key, and its position in the shard: gapless
    from 0, in the pseudo-random order of the keys.  Input columns of these names are replaced."""
    added = ("epoch", "words", "shard", "key")
    (d,) = fresh(mixed, "_draw", also=(*added, "position"))
    rows = mixed.withColumn(d, F.explode(F.col("draws")))
    rows = rows.select(*[col(c) for c in mixed.columns if c.lower() not in ("draws", "position", *added)], *[col(d)[f].alias(f) for f in added])
    others = [c for c in rows.columns if c not in added and not isinstance(rows.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType))]
    return prefix_sums(rows, ["shard"], ["key", "epoch", *others], F.lit(1), "position")


def local_shuffle(drawn: DataFrame, shards: int = 16) -> DataFrame:
    """Drawn rows in the order of their shards and positions: each task holds a part of one or more shards, in order."""
    return drawn.repartition(shards * 4, "shard", F.pmod("position", F.lit(4))).sortWithinPartitions("shard", "position")


def write_mix(drawn: DataFrame, path: str, shards: int = 16) -> None:
    """Write the rows of draw_rows, a folder per shard, in the order of their positions."""
    local_shuffle(drawn, shards).write.partitionBy("shard").parquet(path)


def op1_mixing(docs: DataFrame) -> DataFrame:
    """The mix of all documents by words, one row per document; shards and positions: where each of its uses stands."""
    sized = checkpointed(docs.select("doc_id", "source", word_count(text_or_empty()).alias("size")))
    mixed = checkpointed(mix(sized, ["doc_id"]).withColumn("row", F.monotonically_increasing_id()))
    uses = draw_rows(mixed.select("row", "draws"))
    uses = uses.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "position"))).alias("uses"))  # 3 at most
    none = F.array().cast("array<int>")
    out = mixed.join(uses, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.coalesce(F.col("uses.shard"), none).alias("shards"), F.coalesce(F.col("uses.position"), none.cast("array<long>")).alias("positions"))


def mixing_stage(docs: DataFrame) -> DataFrame:
    """The documents of the mix with the columns of documents: each as many times as it is drawn, whole, in the order of
    shards and of the positions in them.

    Places are found on narrow rows (doc_id, a hash of all columns, source, words); texts are joined once, by doc_id and
    hash.  A null text has no words, and documents without words are not drawn; a null source is a source of its own, a
    null doc_id a value like others.  Rows that agree in all columns are drawn each for itself.  An empty table stays empty;
    columns of any other name, clashing ones included, are carried along.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column of documents can clash with an added one
    doc_id, source = names["doc_id"], names["source"]
    mark = mark_of(docs, *docs.columns)
    rows = docs.select(*[col(c).alias(n) for c, n in names.items()], mark.alias("mark"), word_count(text_or_empty()).alias("words"))
    # the order goes by doc_id and text alone, so further columns do not change which documents are drawn
    narrow = checkpointed(rows.select(F.col(doc_id).alias("d"), F.xxhash64(names["text"]).alias("t"), "mark", F.col(source).alias("s"), F.col("words").alias("n")))
    drawn = draw_rows(mix(narrow, ["d", "t"], size="n", source="s", cut=False).select("d", "mark", "draws")).select("d", "mark", "shard", "position")
    once = rows.drop("words")
    if narrow.groupBy("d", "mark").agg(F.count(F.lit(1)).alias("same")).filter("same > 1").isEmpty() is False:
        once = once.dropDuplicates([doc_id, "mark"])
    joined = once.withColumnRenamed("mark", "m").join(drawn, F.col(doc_id).eqNullSafe(F.col("d")) & (F.col("m") == F.col("mark")))
    return local_shuffle(joined).select(*[F.col(n).alias(c) for c, n in names.items()])
