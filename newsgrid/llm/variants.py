"""Spelling variants: words that differ by one edit, found in tiles of code-point matrices.

Of two words one edit apart, the shorter of length L, either the first L // 2 characters agree or the last L // 2 do.
So words meet under such halves; those of length L and L + 1 that share one are sorted together and cut into blocks of
rows, and pairs of blocks are compared as dense matrices, padded on the right for the common prefix and on the left for
the common suffix.  Prefix and suffix reaching the longer length minus one mean a single edit.  No pair is lost, and
none is found under both of its halves.

A half that more than `split` words share is dealt out by a hash of the words: each pair of parts is a tile of its own,
so no task holds more than two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid.llm.common import checkpointed, col
from newsgrid.operators.rank import small

#: Runs of letters (fixed by the query's contract), shortest word and fewest occurrences.
LETTERS, LEAST_LENGTH, LEAST_N, RATIO = r"[A-Za-zÀ-ÿ]", 6, 5, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a block, and words that share a half in one tile at most.
BLOCK, SPLIT = 256, 8192
_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, every: int = 199) -> DataFrame:
    """(word, n) over whole texts; in one of `every` occurrences, by checksum of document and word, a character is missing."""
    runs = docs.select(F.coalesce(col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(col("text"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("d", lower_ascii(F.col("run")).alias("run"))
    checked = lowered.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return checked.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Block:
    """Rows of one or more tiles: words, counts, and their matrices of code points."""

    def __init__(self, rows: list[tuple]) -> None:
        self.words, self.n = [r[4] for r in rows], [r[5] for r in rows]
        ids, last = [], None
        for r in rows:
            if r[:4] != last:
                last, k = r[:4], len(ids) and ids[-1] + 1
            ids.append(k)
        self.first, self.last, self.tile = rows[0][:4], rows[-1][:4], np.array(ids)
        self.length = np.array([len(w) for w in self.words])
        self.base = np.array([r[0] for r in rows])
        self.suffix = np.array([r[1] for r in rows])  # 1: these words share their last characters
        self.part = np.array([r[6] for r in rows])
        self.across = np.array([r[3] >= 0 and r[3] >> 32 != r[3] & 0xFFFFFFFF for r in rows])
        self.width, self.made = int(self.length.max()), {}

    def matrix(self, width: int, left: bool) -> np.ndarray:
        if (width, left) not in self.made:
            self.made[width, left] = self._matrix(width, left)
        return self.made[width, left]

    def _matrix(self, width: int, left: bool) -> np.ndarray:
        padded = "".join(w.rjust(width, "\0") if left else w.ljust(width, "\0") for w in self.words)
        points = np.frombuffer(padded.encode("utf-32-le"), dtype="<u4").reshape(len(self.words), width)
        return points.astype(np.uint8) if points.max() < 256 else points


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of a with every row of b."""
    alive = a[:, 0][:, None] == b[:, 0][None, :]
    out = alive.astype(np.int32)
    for c in range(1, a.shape[1]):
        alive &= a[:, c][:, None] == b[:, c][None, :]
        if not alive.any():
            break
        out += alive
    return out


def near_in(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that are one edit apart and in one tile; within one block each pair once."""
    same = a.tile[:, None] == b.tile[None, :] if a is b else ((a.tile == a.tile[-1])[:, None] & (b.tile == 0)[None, :])
    same &= ~((a.length > a.base)[:, None] & (b.length > b.base)[None, :])  # two of length L + 1 meet under that length
    same &= ~a.across[:, None] | (a.part[:, None] != b.part[None, :])
    if a is b:
        same &= np.tri(len(a.words), k=-1, dtype=bool)
    if not same.any():
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    width = max(a.width, b.width)
    prefix = common(a.matrix(width, False), b.matrix(width, False))
    reach = prefix + common(a.matrix(width, True)[:, ::-1], b.matrix(width, True)[:, ::-1])
    # pairs whose first halves agree are found there
    same &= (a.suffix[:, None] == 0) | (prefix < (a.base // 2)[:, None])
    return np.nonzero(same & (reach >= np.maximum(a.length[:, None], b.length[None, :]) - 1))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (length, side, half, tile, word, n, part) -> pairs one edit apart, in both directions."""
    rows, open_, out = [], [], []

    def found(block: Block) -> None:
        nonlocal open_
        open_ = [x for x in open_ if x.last == block.first]
        for other in (*open_, block):
            for i, j in zip(*near_in(other, block)):
                x, y = other.words[i], block.words[j]
                out.append((x, y, block.n[j]))
                out.append((y, x, other.n[i]))
        open_ = [*open_, block] if block.first == block.last else [block]

    def give() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PAIRS.types)], schema=_PAIRS)
        out.clear()
        return done

    for batch in batches:
        rows += zip(*[c.to_pylist() for c in batch.columns])
        while len(rows) >= BLOCK:
            found(Block(rows[:BLOCK]))
            rows = rows[BLOCK:]
            if len(out) > 20_000:
                yield give()
    if rows:
        found(Block(rows))
    if out:
        yield give()


def near_words(words: DataFrame, split: int = SPLIT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, near, near_n) for all pairs of distinct words (column word, with n) one edit apart, both ways round."""
    size = F.length("word")

    def half(length: Column, side: int) -> Column:
        h = (length / 2).cast("int")
        return F.struct(length.alias("l"), F.lit(side).alias("side"), (F.right("word", h) if side else F.left("word", h)).alias("half"))

    keyed = words.filter(size >= least_length).select("word", "n", F.explode(F.array(*[half(size - d, s) for d in (0, 1) for s in (0, 1)])).alias("k"))
    keyed = keyed.select("k.l", "k.side", "k.half", "word", "n").filter(F.col("l") >= least_length)
    crowded = keyed.groupBy("l", "side", "half").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > split).withColumn("parts", F.ceil(F.col("m") / split).cast("int")).drop("m")
    dealt = keyed.join(small(checkpointed(crowded)), ["l", "side", "half"], "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    # a word of part p is in the tiles (p, q) of all parts q
    tile = lambda q: F.shiftleft(F.least("part", q).cast("long"), 32) + F.greatest("part", q)
    tiles = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), tile))
    rows = dealt.select("l", "side", "half", F.explode(tiles).alias("tile"), "word", "n", "part")
    order = ["l", "side", "half", "tile"]
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_tiles, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following form leads; forms: word, form.  Counts grow along a chain, so there are no rings; each
    round doubles the steps taken."""
    state = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = checkpointed(state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        state = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return state


def variants(words: DataFrame, ratio: int = RATIO, split: int = SPLIT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a table (word, n; words distinct)."""
    best = F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))
    near = near_words(words, split, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    joined = words.join(near, "word", "left")
    strong = -F.col("best.k") >= ratio * F.col("n")
    known = checkpointed(joined.select("word", F.when(strong, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("best.k")).alias("form_n")))
    lead = roots(known.filter("form IS NOT NULL"))
    return known.join(lead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(docs: DataFrame) -> DataFrame:
    """Frequent words of all texts with their near words, forms and roots.

    A null text has no words and a null doc_id counts as an empty one; repeated rows count each for itself, texts are read
    whole, an empty table gives an empty one, further columns are ignored.  Ties of form go to the smaller word.
    """
    return variants(checkpointed(word_counts(docs).filter(F.col("n") >= LEAST_N)))
