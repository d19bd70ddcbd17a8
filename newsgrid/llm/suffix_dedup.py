"""Removing long repeated byte strings: a sparse suffix array over all texts, sorted deep and shallow.

Every window of `length` bytes holds one anchor, the gram of GRAM bytes with the smallest hash (the first of equals), so
equal windows have equal anchors at equal places.  Neighbouring windows with one anchor are a unit; its context is the
bytes of all its windows.  Suffixes are sampled at anchors, about one in 150 bytes, and only what anchors share is sorted:

- Units go by their gram.  Units of equal context repeat as a whole; a gram met once has no repeat.
- The contexts of a gram that differ are fetched, each once, and compared in one task, a group after the other.  The
  suffixes that start at the anchor are sorted deep and shallow: multikey quicksort to SHALLOW bytes behind the gram,
  blind tries for what still agrees there.  Their neighbours give the common length to the right; what stands before the
  anchor is sorted likewise for the common length to the left.  Suffixes are joined by falling common length, each joined
  set kept in left order, so that the nearest in it tell which windows repeat (see `repeats`).
- A gram of more than `hot` units is counted by context with partial sums and joined, not gathered; a group of more than
  `group` different contexts is compared by the hashes of its windows, counted likewise.

Documents of equal text are one document met twice: they are removed whole and stand in for each other's units.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import checkpointed, col, ensure_checkpoint_dir, text_batches
from newsgrid.operators.rank import small

LENGTH, GRAM, SHALLOW = 400, 100, 32
#: Windows whose hashes are computed at a time (memory, not results).
SEGMENT = 1 << 20
#: Units of a gram and contexts of a group above which they are split.
HOT, GROUP = 50_000, 20_000
#: Low bits of a hash that give way to the place in a segment.
_PLACE = np.uint64((1 << 22) - 1)
_rng = np.random.default_rng(12)
_BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNIT = pa.struct([("k", pa.int64()), ("c", pa.int64()), ("p", pa.int32()), ("o", pa.int32()), ("w", pa.int32()), ("m", pa.int32())])
_SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
UNIT_SQL, SPAN_SQL = "struct<k:long,c:long,p:int,o:int,w:int,m:int>", "struct<s:int,e:int>"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    make = lambda b: np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b, dtype=np.uint64))])
    return make(np.uint64(_BASE)), make(np.uint64(inverse))


_table: list[np.ndarray] = []


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all grams: differences of running polynomial sums, mixed."""
    if not _table or len(_table[0]) <= len(data):
        _table[:] = _powers(max(len(data) + 1, SEGMENT + LENGTH + 1))
    up, down = _table
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by running minima of blocks from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of every window."""
    h = gram_hashes(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    least = (first_least((h & ~_PLACE) | place, length - gram + 1) & _PLACE).astype(np.int64)
    return least, h[least]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def units(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, k, c, p, o, w) of the units of texts that lie in data one after the other, by their offsets: hashes of gram
    and context, first window, distance of the anchor from it, windows besides it."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        place, hashes = anchors(part, length, gram)
        start = np.arange(at, at + len(place))
        doc = np.searchsorted(offsets, start, side="right") - 1
        inside = start + length <= offsets[doc + 1]
        start, place, hashes, doc = start[inside], place[inside] + at, hashes[inside], doc[inside]
        if not len(start):
            continue
        turn = np.flatnonzero((place[1:] != place[:-1]) | (doc[1:] != doc[:-1])) + 1
        first, last = np.concatenate([[0], turn]), np.concatenate([turn - 1, [len(start) - 1]])
        p, q, o = start[first], start[last] - start[first], place[first] - start[first]
        view = memoryview(np.ascontiguousarray(part))
        c = np.fromiter((xxhash.xxh64_intdigest(view[a - at : a - at + w + length], int(d)) for a, w, d in zip(p.tolist(), q.tolist(), o.tolist())), dtype=np.uint64, count=len(p))
        out.append((doc[first], hashes[first].view(np.int64), c.view(np.int64), p - offsets[doc[first]], o, q))
    return tuple(map(np.concatenate, zip(*out))) if out else tuple(np.empty(0, dtype=np.int64) for _ in range(6))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scan(length: int, gram: int):
    """(id, text) -> a row for each document: id, key, n, sha, its units, each context once, and the spans of contexts that
    the document itself repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _flat(batch.column(1))
            doc, k, c, p, o, w = units(data, offsets, length, gram)
            order = np.lexsort((p, c, k, doc))
            doc, k, c, p, o, w = (x[order] for x in (doc, k, c, p, o, w))
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.concatenate([first, [len(doc)]]))
            own: dict[int, list] = {}
            for i in np.flatnonzero(np.repeat(many, many) > 1).tolist():
                own.setdefault(int(doc[i]), []).append((int(p[i]), int(p[i] + w[i] + length)))
            spans = [merged(own.get(i, [])) for i in range(batch.num_rows)]
            at = np.searchsorted(doc[first], np.arange(batch.num_rows + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(x[first].astype(t)) for x, t in ((k, np.int64), (c, np.int64), (p, np.int32), (o, np.int32), (w, np.int32))] + [pa.array(np.minimum(many, 2).astype(np.int32))], fields=list(_UNIT))
            view, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
            parts = [view[a:b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.md5(x).digest() for x in parts], pa.binary()), pa.array(np.diff(offsets)), pa.array([hashlib.sha256(x).hexdigest() for x in parts]), pa.ListArray.from_arrays(pa.array(at), flat), pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], pa.list_(_SPAN))],
                names=[batch.schema.names[0], "key", "n", "sha", "units", "spans"],
            )

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - (((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) >> 3)


def _blind(strings: list[bytes], ids: list[int], depth: int) -> list[int]:
    """ids in the order of their strings, which agree in `depth` bytes, by a blind trie: a node is [depth, children by next
    byte (-1: the end)], a leaf a list of ids of equal strings.  The way down looks at branching bytes only; one comparison
    with the leaf it ends in tells where the new string belongs."""
    byte = lambda s, d: s[d] if d < len(s) else -1
    root: tuple | list = [ids[0]]
    for i in ids[1:]:
        s, node = strings[i], root
        while isinstance(node, tuple):
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        if other == s:
            node.append(i)
            continue
        d = depth + common_prefix(s[depth:], other[depth:])
        above, node = None, root
        while isinstance(node, tuple) and node[0] < d:
            above, node = node, node[1][byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == d:
            node[1][byte(s, d)] = [i]
            continue
        split = (d, {byte(other, d): node, byte(s, d): [i]})
        if above is None:
            root = split
        else:
            above[1][byte(s, above[0])] = split
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        if isinstance(node, tuple):
            open_ += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], start: int = 0, shallow: int = SHALLOW) -> list[int]:
    """The order of strings that agree in `start` bytes: multikey quicksort by eight bytes at a time for `shallow` bytes,
    then blind tries."""
    out, open_ = [], [(list(range(len(strings))), start)]
    while open_:
        ids, depth = open_.pop()
        if len(ids) < 2:
            out += ids
            continue
        if depth >= start + shallow:
            out += _blind(strings, ids, depth)
            continue
        keys = [strings[i][depth : depth + 8] for i in ids]
        pivot = keys[len(keys) // 2]
        less, same, more = [], [], []
        for i, x in zip(ids, keys):
            (same if x == pivot else less if x < pivot else more).append(i)
        # strings that end within the pivot are equal, which a trie finds at once
        open_ += [(more, depth), (same, depth + 8 if len(pivot) == 8 else start + shallow), (less, depth)]
    return out


def repeats(left: list[bytes], right: list[bytes], open_: list[bool], length: int, gram: int) -> list[tuple[int, int, int]]:
    """(i, least, most): windows of string i that also stand in another one, by the distance of their start from the anchor.

    left: what stands before the anchor, turned round; right: what starts there.  Only strings that are open_ are told of.
    The window at distance d of two strings agrees if d bytes to the left and length - d to the right do.  Neighbours in the
    sorted right parts are joined by falling common length R; a set joined so far agrees in R bytes at least.  Each set is
    kept in left order, where the nearest two share most, so only new neighbours are compared.
    """
    start = gram if all(x[:gram] == right[0][:gram] for x in right) else 0  # grams of one hash agree, as a rule
    order, lefts = deep_shallow(right, start), deep_shallow(left)
    rank = {i: r for r, i in enumerate(lefts)}
    steps = sorted(((common_prefix(right[a], right[b]), j) for j, (a, b) in enumerate(zip(order, order[1:]))), reverse=True)
    parent, sets = list(range(len(order))), [[rank[i]] for i in order]

    def home(j: int) -> int:
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        return j

    out = []
    for r, j in steps:
        a, b = home(j), home(j + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for z in sets[b]:
            at = bisect_left(large, z)
            for near in large[max(0, at - 1) : at + 1]:
                x, y = lefts[z], lefts[near]
                if open_[x] or open_[y]:
                    d = common_prefix(left[x], left[y])
                    if d + r >= length:
                        out += [(i, length - r, d) for i in (x, y) if open_[i]]
            insort(large, z)
        sets[b], parent[b] = [], a
    return out


def _compared(length: int, gram: int):
    """Contexts (k, key, p, o, w, many, body), sorted, those of a gram together -> repeated spans of those met once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, [], []

        def close() -> None:
            if len(group) < 2:
                return
            found = repeats([g[5][: g[2]][::-1] for g in group], [g[5][g[2] :] for g in group], [not g[4] for g in group], length, gram)
            for i, least, most in set(found):
                key, p, o, w, _, _ = group[i]
                least, most = max(least, o - w), min(most, o)
                if least <= most:
                    out.append((key, p + o - most, p + o - least + length))

        for batch in batches:
            for k, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if k != at:
                    close()
                    at, group = k, []
                if not group or group[-1][:2] != row[:2]:  # a text can have been read in several places
                    group.append(row)
            if len(out) > 20_000:
                yield _span_batch(out)
                out.clear()
        close()
        if out:
            yield _span_batch(out)

    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int32()))], names=["key", "s", "e"])


def _hashed(length: int):
    """Contexts -> hash, key, place and multiplicity of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, key, p, o, w, many, body in zip(*[c.to_pylist() for c in batch.columns]):
                h = [xxhash.xxh3_128_digest(body[i : i + length]) for i in range(w + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([key] * (w + 1)), pa.array(range(p, p + w + 1), pa.int32()), pa.array([1 + many] * (w + 1), pa.int32())], names=["h", "key", "s", "m"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their keys, each key once in a partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keys = [hashlib.md5((t or "").encode()).digest() for t in batch.column(0).to_pylist()]
        new = [i for i, x in enumerate(keys) if not (x in seen or seen.add(x))]
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), batch.column(0).take(pa.array(new, pa.int64()))], names=["key", "text"])


def _texts_of(docs: DataFrame, wanted: DataFrame, few: int = 200_000) -> DataFrame:
    """wanted (key, unique, and more) with the text of each key, for each partition of docs that holds one."""
    texts = docs.select(col("text").alias("text")).mapInArrow(_once, "key binary, text string")
    keys = wanted.select("key")
    if keys.limit(few + 1).count() <= few:
        texts = texts.join(F.broadcast(keys), "key", "left_semi")
    return texts.join(wanted, "key")


def _cut_out(length: int):
    """(text, asked) -> the contexts asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["k", "key", "p", "o", "w", "many", "body"], []
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        for batch in batches:
            for key, text, asked in zip(*[c.to_pylist() for c in batch.columns]):
                data = text.encode()
                out += [(u["k"], key, u["p"], u["o"], u["w"], u["many"], data[u["p"] : u["p"] + u["w"] + length]) for u in asked]
                if len(out) > 5000:
                    yield give()
                    out.clear()
        if out:
            yield give()

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, spans) -> key, the spans as maximal runs, and the bytes outside of them."""
    for batch in batches:
        for key, text, spans in zip(*[c.to_pylist() for c in batch.columns]):
            data, runs = text.encode(), merged([(x["s"], x["e"]) for x in spans])
            ends = [0, *[x for run in runs for x in run], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([[{"s": a, "e": b} for a, b in runs]], pa.list_(_SPAN)), pa.array([kept], pa.binary())], names=["key", "runs", "kept"])


def _stored(df: DataFrame, at: str) -> DataFrame:
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def _shared(rows: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(spans, contexts) of units k, c, key, p, o, w, m, whole: the spans of contexts met twice or more, and every different
    context, once, of the grams that have more than one.  Whether a gram is hot is read off a sample of one unit in 64: it
    decides between two ways to the same rows."""
    often = rows.select("k").sample(1 / 64, seed=7).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot / 64).select("k")
    often = checkpointed(often)
    span = lambda d: d.filter(~F.col("whole")).select("key", F.col("p").alias("s"), (F.col("p") + F.col("w") + length).alias("e"))
    names = ["k", "key", "p", "o", "w", "many"]

    def sorted_out(d: DataFrame) -> tuple[DataFrame, DataFrame]:
        gram, context = Window.partitionBy("k"), Window.partitionBy("k", "c")
        seen = d.repartition("k").withColumns({"least": F.min("c").over(gram), "most": F.max("c").over(gram)}).withColumns({"met": F.sum("m").over(context), "turn": F.row_number().over(context.orderBy("key", "p"))})
        seen = seen.filter("met > 1 OR least < most").withColumn("many", (F.col("met") > 1).cast("int"))
        return seen, seen.filter("least < most AND turn = 1").select(*names)

    def counted(d: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = checkpointed(d.groupBy("k", "c").agg(F.sum("m").alias("met"), F.min(F.struct("key", "p", "o", "w")).alias("one")))
        several = met.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
        again = d.join(met.filter("met > 1").select("k", "c"), ["k", "c"])
        return again, met.join(several, "k").select("k", "one.*", (F.col("met") > 1).cast("int").alias("many"))

    if often.isEmpty():
        seen, mixed = sorted_out(rows)
        return span(seen.filter("met > 1")), mixed
    seen, mixed = sorted_out(rows.join(small(often), "k", "left_anti"))
    again, more = counted(rows.join(small(often), "k", "left_semi"))
    return span(seen.filter("met > 1")).unionByName(span(again)), mixed.unionByName(more.select(*names))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, sha256 (of the whole text), runs (what goes: an array of start and end, maximal and in order) and kept
    (the bytes that stay; null: all of them) of every document.

    What goes is every byte in a string of `length` bytes that starts in another place too, of this document or another.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/repeats-{uuid.uuid4().hex}"
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, n long, sha string, units array<{UNIT_SQL}>, spans array<{SPAN_SQL}>"
    with text_batches(spark):
        scanned = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text")).mapInArrow(_scan(length, gram), schema)
        scanned = _stored(scanned.withColumn("row", F.monotonically_increasing_id()), f"{at}/scan")
        copies = scanned.filter(F.col("n") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("one")).filter("copies > 1")
        copies = _stored(copies.drop("copies"), f"{at}/copies")
        known = scanned.join(small(copies), "key", "left").withColumn("whole", F.col("one").isNotNull())
        told = known.filter(~F.col("whole") | (F.col("row") == F.col("one")))
        rows = told.select("key", "whole", F.explode("units").alias("u")).select("u.k", "u.c", "key", "u.p", "u.o", "u.w", F.when(F.col("whole"), 2).otherwise(F.col("u.m")).alias("m"), "whole")
        spans, mixed = _shared(rows, length, hot)
        spans, mixed = _stored(spans, f"{at}/spans"), _stored(mixed, f"{at}/mixed")
        asked = mixed.groupBy("key").agg(F.collect_list(F.struct("k", "p", "o", "w", "many")).alias("asked"))  # bounded by the text
        contexts = _texts_of(docs, asked).select("key", "text", "asked").mapInArrow(_cut_out(length), "k long, key binary, p int, o int, w int, many int, body binary")
        crowded = _stored(mixed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("k"), f"{at}/crowded")
        order = ["k", "key", "p"]
        if crowded.isEmpty():
            few = contexts
        else:
            contexts = _stored(contexts, f"{at}/contexts")
            few = contexts.join(small(crowded), "k", "left_anti").select(contexts.columns)
        found = few.repartition("k").sortWithinPartitions(*order).mapInArrow(_compared(length, gram), "key binary, s int, e int")
        if not crowded.isEmpty():
            many = contexts.join(small(crowded), "k", "left_semi").select(contexts.columns).dropDuplicates(order)
            windows = _stored(many.mapInArrow(_hashed(length), "h binary, key binary, s int, m int"), f"{at}/windows")
            twice = windows.groupBy("h").agg(F.sum("m").alias("n")).filter("n > 1").select("h")
            found = found.unionByName(windows.filter("m = 1").join(twice, "h").select("key", "s", (F.col("s") + length).alias("e")))
        found = _stored(found, f"{at}/found")
        own = known.filter(~F.col("whole")).select("key", F.explode("spans").alias("x")).select("key", "x.s", "x.e")
        per_text = _stored(spans.unionByName(found).unionByName(own).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans")), f"{at}/per_text")
        cut = _stored(_texts_of(docs, per_text).select("key", "text", "spans").mapInArrow(_kept, f"key binary, runs array<{SPAN_SQL}>, kept binary"), f"{at}/cut")
    judged = known.filter(~F.col("whole")).join(cut, "key", "left")
    all_of = F.array(F.struct(F.lit(0).alias("s"), F.col("n").cast("int").alias("e")))
    gone = known.filter("whole").withColumns({"runs": all_of, "kept": F.lit(b"")})
    names = ["doc_id", F.col("n").alias("n_bytes"), F.col("sha").alias("sha256"), F.coalesce("runs", F.array().cast(f"array<{SPAN_SQL}>")).alias("runs"), "kept"]
    return judged.select(*names).unionByName(gone.select(*names))


def op12_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Bytes that repeated strings of 400 bytes take from every document, and the digest of the rest.

    A null text is empty; rows of equal texts remove each other whole if they have 400 bytes; an empty table gives an empty
    one; further columns are ignored.
    """
    out = remove_repeats(docs)
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["e"] - x["s"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.coalesce(F.sha2("kept", 256), "sha256").alias("kept_sha256"))
