"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only).

Every row gets a global number 0..n-1, the number is permuted by a keyed Feistel network with cycle walking, and the
permuted number p gives shard p mod S and slot p div S.  Row counts of shards differ by at most one, slots have no
gaps, and both directions are computable from (number, n, seed) alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import checkpointed, col, fresh, text_or_empty, without

ROUNDS = 6
#: Walking steps written into the expression.  A step leaves the domain with a chance of about 1/sqrt(n), and a walk
#: is never longer than the at most sqrt(n) points outside; a row that needed more would stop the job, never go wrong.
WALK = 64


def _radices(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _mix(seed: Column, r: Column, half: Column, radix: Column) -> Column:
    return F.pmod(F.xxhash64(seed, r, half), radix)


def _network(x: Column, a: Column, b: Column, seed: Column, forward: bool) -> Column:
    """One pass of the network over [0, a*b): the two mixed-radix digits are changed in turn."""
    order = range(ROUNDS) if forward else range(ROUNDS - 1, -1, -1)
    steps = F.array(*[F.lit(r) for r in order])

    def step(state: Column, r: Column) -> Column:
        left, right = state["l"], state["r"]
        sign = F.lit(1 if forward else -1)
        return F.when(r % 2 == 0, F.struct(F.pmod(left + sign * _mix(seed, r, right, a), a).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), F.pmod(right + sign * _mix(seed, r, left, b), b).alias("r")))

    start = F.struct(_div(x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(steps, start, step, lambda s: s["l"] * b + s["r"])


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def permute(x: Column, n: Column | int, seed: Column | int, inverse: bool = False) -> Column:
    """The place of x in a pseudo-random permutation of [0, n); n and seed may be columns.  inverse: from the place to x."""
    if isinstance(n, int):
        a, b = (F.lit(v).cast("long") for v in _radices(n))
        size = F.lit(n).cast("long")
    else:
        size = n.cast("long")
        a = F.greatest(F.ceil(F.sqrt(size.cast("double"))).cast("long"), F.lit(1).cast("long"))
        b = F.greatest(F.ceil(size / a).cast("long"), F.lit(1).cast("long"))
    key = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    walk = F.sequence(F.lit(1), F.lit(WALK))
    first = _network(x.cast("long"), a, b, key, not inverse)
    return F.aggregate(walk, first, lambda at, _: F.when(at < size, at).otherwise(_network(at, a, b, key, not inverse)), lambda at: F.when(at < size, at).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def number_rows(df: DataFrame, number: str, seed: int = 42, buckets: int = 1024, block: int = 65536) -> tuple[DataFrame, int]:
    """Rows of df with a global number 0..n-1 that depends on their content alone, and n.

    Rows that agree in every column are first counted, so a row repeated without end is one record until it is
    numbered, in blocks of `block` copies that go to different buckets.  Each bucket is numbered on its own after the
    sums of the earlier ones.  Every column must be of a type that can be grouped (no maps).
    """
    cols = list(df.columns)
    n, lo, m, b, h, base = fresh(df, "_n", "_lo", "_m", "_b", "_h", "_base")
    counted = df.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias(n))
    blocks = counted.withColumn(lo, F.explode(F.sequence(F.lit(0).cast("long"), col(n) - 1, F.lit(block).cast("long")))).withColumn(m, F.least(F.lit(block).cast("long"), col(n) - col(lo)))
    blocks = blocks.withColumn(h, F.xxhash64(F.lit(seed), *[col(c) for c in cols], col(lo))).withColumn(b, F.pmod(F.shiftright(col(h), 17), F.lit(buckets)).cast("int")).drop(n)
    blocks = checkpointed(blocks)
    sums = blocks.groupBy(col(b)).agg(F.sum(col(m)).alias(m))
    total = sums.agg(F.sum(col(m))).first()[0] or 0
    # one row per bucket: `buckets` rows at most, whatever the input
    starts = sums.select(col(b), F.coalesce(F.sum(col(m)).over(Window.orderBy(col(b)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    inside = Window.partitionBy(col(b)).orderBy(col(h), *[col(c) for c in cols], col(lo)).rowsBetween(Window.unboundedPreceding, -1)
    first = col(base) + F.coalesce(F.sum(col(m)).over(inside), F.lit(0))
    numbered = blocks.join(F.broadcast(starts), b).withColumn(number, first)
    return numbered.select(*[col(c) for c in cols], F.explode(F.sequence(col(number), col(number) + col(m) - 1)).alias(number)), total


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """df with `shard` (0..shards-1) and `slot` (gapless from 0 in each shard); counts of shards differ by one at most.

    Nulls in any column are values like others; repeated rows each get a place of their own; an empty table gives an
    empty result; input columns named shard or slot are replaced.  Equal texts are not kept together: the permutation
    spreads them.  Reruns give the same rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = without(df, "shard", "slot")
    (number,) = fresh(df, "_number")
    numbered, total = number_rows(df, number, seed, buckets)
    place = permute(col(number), total, seed)
    out = numbered.withColumn(number, place)
    return out.select(*[col(c) for c in df.columns], (col(number) % shards).cast("int").alias("shard"), _div(col(number), F.lit(shards)).cast("long").alias("slot"))


def row_number_at(shard: Column, slot: Column, total: int, shards: int = 16, seed: int = 42) -> Column:
    """The global row number that stands in this shard and slot (inverse of the placement)."""
    return permute(slot.cast("long") * shards + shard, total, seed, inverse=True)


def document_digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1; null text: 1) and text_crc32 of every document."""
    text = text_or_empty().cast("binary")
    return docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def op8_sharding(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Shards of all documents under the law `rows`: only the narrow digests are moved."""
    placed = shard_rows(document_digests(docs), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
