"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Two 64-bit fingerprints that differ in at most k bits agree in at least b-k of b blocks, so they share one of the
C(b, k) keys made of b-k blocks.  Fingerprints are joined on such keys and the true distance is checked.  A key shared
by more than `crowd` fingerprints is not joined as it is: its members are keyed again on the bits that the key leaves
open, level after level, until a key leaves 8 bits and thus 256 members at most.  No pair is lost and none is made
from an unbounded group.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrid.llm.common import checkpointed, col, fresh, text_batches
from newsgrid.operators.components import connected_components

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text: bit i is 1 if it is set in over half the shingle hashes; no words: 0."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[shingle - 1 :])), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed long."""
    return F.pandas_udf(_fingerprints, T.LongType())(text)


def _masks(open_bits: list[int], blocks: int, distance: int) -> list[int]:
    """Masks over open_bits that keep blocks-distance of the blocks they are cut into."""
    cut = np.array_split(np.array(open_bits), blocks)
    return [sum(1 << int(i) for part in kept for i in part) for kept in combinations(cut, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(points: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 64) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints, column fp, within `distance` bits."""
    masks, found = [0], []
    rows = points.select(F.col("fp"), F.lit(0).alias("t"))
    while True:
        deeper = [m | s for m in masks for s in _masks([i for i in range(64) if not m >> i & 1], blocks, distance)]
        per = len(deeper) // len(masks)
        table = F.array(*[F.lit(_signed(m)) for m in deeper])
        keyed = rows.select("fp", F.explode(F.sequence(F.col("t") * per, F.col("t") * per + per - 1)).alias("t"))
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.element_at(table, F.col("t") + 1)))
        sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        keyed = checkpointed(keyed.join(sizes, ["t", "key"]))
        left = 64 - bin(deeper[0]).count("1")
        last = left <= 8
        few = keyed if last else keyed.filter(F.col("n") <= crowd)
        a, b = few.select("t", "key", F.col("fp").alias("a")), few.select("t", "key", F.col("fp").alias("b"))
        near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        found.append(a.join(b, ["t", "key"]).filter(near).select("a", "b"))
        rows = keyed.filter(F.col("n") > crowd).select("fp", "t")
        if last or rows.isEmpty():
            return reduce(DataFrame.union, found).distinct()
        masks = deeper


def components(rows: DataFrame, fp: str, doc_id: str) -> DataFrame:
    """(fp, root, component): for every fingerprint of rows the smallest fingerprint and the smallest doc_id that near
    pairs lead to (null: no doc_id known).  Only root tells components apart: doc_ids may be null or repeated."""
    points = checkpointed(rows.groupBy(col(fp).alias("fp")).agg(F.min(col(doc_id)).alias("first")))
    labels = connected_components(near_pairs(points))
    rooted = points.join(labels.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpointed(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return checkpointed(rooted.join(least, "root").select("fp", "root", "component"))


def op7_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of all documents.

    A null, empty or blank text has fingerprint 0; equal fingerprints link, whatever their texts; a null doc_id never
    names a component unless all its members are null.
    """
    with text_batches(docs.sparkSession):
        prints = checkpointed(docs.select("doc_id", fingerprint_of(col("text")).alias("fp")))
    out = prints.join(components(prints, "fp", "doc_id"), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, named: DataFrame, mark: str, content: Column) -> DataFrame:
    """The document with the smallest doc_id (null last, then by mark) of each root; named: doc_id, mark (content's value,
    a name that docs lacks) and root.  Rows with the winner's doc_id and mark are one document."""
    d, m, same = fresh(docs, "_d", "_m", "_same", also=(mark,))
    rows = named.groupBy("root", col("doc_id").alias(d), col(mark).alias(m)).agg(F.count(F.lit(1)).alias(same))
    best = rows.groupBy("root").agg(F.min(F.struct(col(d).isNull().alias("n"), col(d).alias("d"), col(m).alias("m"), col(same).alias("same"))).alias("w"))
    winners = checkpointed(best.select(F.col("w.d").alias(d), F.col("w.m").alias(m), F.col("w.same").alias(same)))
    marked = docs.withColumn(mark, content)
    won = col(mark).eqNullSafe(col(m)) & col("doc_id").eqNullSafe(col(d))
    kept = marked.join(winners, won, "left_semi")
    again = winners.filter(col(same) > 1)
    if not again.isEmpty():  # rows that are there more than once: the others need no second shuffle
        twice = marked.join(again, won, "left_semi").dropDuplicates(["doc_id", mark])
        kept = marked.join(winners.filter(col(same) == 1), won, "left_semi").unionByName(twice)
    return kept.select(*[col(x) for x in docs.columns])
