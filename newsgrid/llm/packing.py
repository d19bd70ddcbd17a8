"""Packing documents into sequences: shortest pack first over the length histogram.

Texts are tokenised where they lie and cut into pieces of at most `length` tokens.  The histogram of piece lengths
(at most `length` rows) is packed on the driver by counts alone: lengths are placed longest first, each time into the
emptiest packs that exist, so that patterns are split and extended with their counts.  The patterns are then joined
back: the pieces of a length are ranked, and a rank tells its pattern, its sequence and its place.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrid.llm.common import checkpointed, col, fresh, prefix_sums, text_batches, without

LENGTH = 2048
END = 1
#: Words in each of the two generations that a worker keeps the ids of; speed only.
KEPT_WORDS = 1_000_000
#: Characters outside plain Latin, whose lower case or normal form may depend on their neighbours.
ODD = re.compile("[^\x00-\u012f\u0131-\u024f]")
_encoders: dict[str, "Encoder"] = {}


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer lowers case, drops white space and never joins across it, so ids are kept by word.  New words of
    letters go through it many at a time, joined by spaces: a word of letters ends with the first id of an end-of-word
    token.  A full stop or comma after such a word is a token of its own.  Of the words seen, a young and an old
    generation are kept; a word that is met again becomes young.
    """

    def __init__(self, path: str, kept: int) -> None:
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.marks = {m: _bytes(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in ".,"}

    def whole(self, words: list[str]) -> list[bytes]:
        return [_bytes(got.ids) for got in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words that hold letters only."""
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(part) else self.whole(part)
        return out

    def learn(self, new: set[str]) -> None:
        cores, rest = {}, []
        for word in new:
            core = word[:-1] if word[-1:] in self.marks else word
            if core.isalpha() and not ODD.search(core):
                cores[word] = core.lower()
            else:
                rest.append(word)
        plain = list(set(cores.values()))
        ids = dict(zip(plain, self.letters(plain)))
        for word, core in cores.items():
            self.young[word] = ids[core] + self.marks[word[-1]] if len(word) > len(core) else ids[core]
        self.young.update(zip(rest, self.whole(rest)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 1024):
            split = [t.replace("\n", " ").split(" ") for t in texts[i : i + 1024]]
            if len(self.young) > self.kept:
                self.old, self.young = self.young, {}
            new = set().union(*split).difference(self.young)
            again = new.intersection(self.old)
            self.young.update(zip(again, map(self.old.__getitem__, again)))
            new -= again
            self.learn(new)
            for words in split:
                yield b"".join(map(self.young.__getitem__, words))
            for word in new:
                if len(word) > 64:
                    del self.young[word]


def _encode(texts: list[str], path: str, kept: int = KEPT_WORDS) -> Iterator[bytes]:
    if path not in _encoders:
        _encoders[path] = Encoder(path, kept)
    _encoders[path].kept = kept
    return _encoders[path].encode(texts)


def pieces_of(path: str, length: int, end: int, keep_ids: bool, kept: int = KEPT_WORDS) -> Callable:
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out: list[tuple] = []
            for key, ids in zip(keys, _encode(texts, path, kept)):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((key, start, len(part) // 4, zlib.crc32(part), n, np.frombuffer(part, dtype="<u4").tolist() if keep_ids else None))
            k, s, m, c, n, ids = zip(*out) if out else ((),) * 6
            columns = [pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(m, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def tokenize(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, keep_ids: bool = False, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Pieces of every document (null text: empty, so only the end id): doc_id, start, length, ids_crc32, doc_tokens[, ids]."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if keep_ids else "")
    return docs.select(col("doc_id").cast("long"), col("text")).mapInArrow(pieces_of(path, length, end, keep_ids, kept_words), schema)


def pack_histogram(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((piece length, times), ...) with the number of sequences of each."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []  # heap of -room

    def put(room: int, pattern: tuple[tuple[int, int], ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            heapq.heappush(rooms, -room)
        open_[room].append((pattern, n))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = -rooms[0] if rooms else 0
            if room < size:
                put(length - size, ((size, 1),), left)
                break
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                heapq.heappop(rooms)
            used = min(n, left)
            if used < n:
                put(room, pattern, n - used)
            again = pattern[-1][0] == size
            grown = (*pattern[:-1], (size, pattern[-1][1] + 1)) if again else (*pattern, (size, 1))
            put(room - size, grown, used)
            left -= used
    return [p for parts in open_.values() for p in parts]


def _ranges(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its runs of ranks: (first rank, times per sequence, first sequence, offset)."""
    next_rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for size, times in pattern:
            lo = next_rank.get(size, 0)
            out.setdefault(size, []).append((lo, times, sequence, offset))
            next_rank[size] = lo + n * times
            offset += size * times
        sequence += n
    return out


def pack(pieces: DataFrame, length: int = LENGTH, seed: int = 42) -> DataFrame:
    """pieces with sequence_id and offset; `length` of a piece is 1..length.

    Pieces that agree in all of doc_id, start and ids_crc32 are interchangeable; their columns may be null but for
    length.  Input columns named like the added ones are replaced; no pieces give no rows.
    """
    spark = pieces.sparkSession
    pieces = without(pieces, "sequence_id", "offset")
    rank, its_runs, at, k = fresh(pieces, "_rank", "_runs", "_run", "_k")
    # at most `length` rows reach the driver, whatever the input
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = _ranges(pack_histogram(histogram, length))
    schema = T.StructType([T.StructField("length", T.LongType(), False), T.StructField(its_runs, T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("lo", "times", "sequence", "offset")])))])
    table = spark.createDataFrame([(k, sorted(v)) for k, v in runs.items()], schema)
    ranked = prefix_sums(pieces, ["length"], ["doc_id", "start", "ids_crc32"], F.lit(1), rank, seed=seed)
    placed = ranked.join(F.broadcast(table), "length")
    run = F.element_at(F.filter(its_runs, lambda r: r["lo"] <= col(rank)), -1)
    placed = placed.withColumn(at, run).withColumn(k, col(rank) - col(at)["lo"])
    sequence = col(at)["sequence"] + F.call_function("div", col(k), col(at)["times"])
    offset = col(at)["offset"] + (col(k) % col(at)["times"]) * F.col("length")
    return placed.select(*[col(c) for c in pieces.columns], sequence.alias("sequence_id"), offset.alias("offset"))


def op4_packing(docs: DataFrame, path: str | None = None, kept_words: int = KEPT_WORDS) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, one row per piece; kept_words trades a worker's memory for time.

    A null or empty text has the end id alone; repeated rows are packed each, and rows that agree are interchangeable; an
    empty table gives an empty one; further columns are ignored.
    """
    with text_batches(docs.sparkSession):
        pieces = checkpointed(tokenize(docs, path, kept_words=kept_words))
    return pack(pieces)
