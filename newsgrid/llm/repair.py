"""Repairing the structure of conversations: the cheapest edits that make their roles follow the grammar `(s?(ua)+)?`.

A turn is one symbol: its role (s, u, a or o for any other) and its fault.  Blank and duplicate turns must go (d), a
truncated one has its role in upper case.  The grammar has four states (start, after s, after u, after a), so a run of
symbols is a min-plus matrix of 4 x 4 entries (cost, audit), an audit being the edits in order: K keeps a turn, R gives
it another role, D deletes it, I inserts an empty one.  An audit and the state it starts in tell where it ends.  Inserts
stand before the turn they precede, so audits of one run are of one count of turns and none is a prefix of another:
least audits put together are least.

The symbols of all conversations are compressed by Re-Pair: rounds count adjacent pairs over the distinct sequences in
Spark and turn frequent ones into rules.  Each rule has one matrix, made from those of its two parts, its audits as
ropes of theirs; conversations share them.  MAX_RULES bounds the table, and so speed, not results.

A conversation is never gathered: turns are sorted over all tasks and cut into pieces of at most PIECE turns.  Each
piece gives its matrix with the order of its audits, 32 small numbers; these are put together per conversation, and
each piece then writes its part of the audit.  The repaired text has one digest for a conversation, so its turns stream
through one task, which holds one turn at a time and the audit.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrid.llm.common import SPACES, checkpointed, col

#: Costs of the edits, and what a truncated turn adds that is not deleted (fixed values).
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns in a piece, rules of the grammar and rounds of its making at most; audits that a worker remembers.
PIECE, MAX_RULES, MAX_ROUNDS, REMEMBERED = 4096, 512, 12, 50_000
#: Distinct runs that one task counts the pairs of, about.
RUNS = 20_000
#: The state after each role, from each state (None: the role cannot stand there).
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: What an insert or a new role is in each state, and the inserts that complete a conversation there.
FORCED, TAIL = "uuau", ("", "II", "I", "")
NAMES = {"u": "user", "a": "assistant"}
Rope = str | tuple
Matrix = list[list[tuple[int, Rope] | None]]
NO_ROWS: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def spell(rope: Rope) -> str:
    """The string of a rope."""
    out, open_ = [], [rope]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            open_ += [x[1], x[0]]
    return "".join(out)


def symbol_matrix(symbol: str) -> Matrix:
    """Edits of one turn, with the inserts before it."""
    role, cut = symbol.lower(), TRUNCATED * symbol.isupper()
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at = i
        for inserts in range(3):  # a third one only repeats a state
            ways = [(DELETE, "D", at)]
            if symbol != "d":
                ways += [(RELABEL + cut, "R", NEXT[FORCED[at]][at])]
                if role in NEXT and NEXT[role][at] is not None:
                    ways += [(cut, "K", NEXT[role][at])]
            for cost, letter, j in ways:
                new = (cost + INSERT * inserts, "I" * inserts + letter)
                if out[i][j] is None or new < out[i][j]:
                    out[i][j] = new
            at = NEXT[FORCED[at]][at]
    return out


def after(x: Matrix, y: Matrix) -> Matrix:
    """The matrix of two runs, one after the other.  Of equal costs the first parts decide: from one state to different
    ones their audits differ, and none is a prefix of another."""
    out: Matrix = []
    for row in x:
        best: list = [None] * 4
        for k, first in enumerate(row):
            if first is None:
                continue
            for j, second in enumerate(y[k]):
                if second is None:
                    continue
                cost, old = first[0] + second[0], best[j]
                if old is None or cost < old[0] or cost == old[0] and spell(first[1]) < spell(old[1][0]):
                    best[j] = (cost, (first[1], second[1]))
        out.append(best)
    return out


class Grammar:
    """The rules, as (pair, symbol), and a matrix of each symbol, made bottom-up."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules, self.known = rules, {}
        self.of = {c: symbol_matrix(c) for c in "dsuaoSUAO"}
        for pair, symbol in rules:
            self.of[symbol] = after(self.of[pair[0]], self.of[pair[1]])

    def compress(self, run: str) -> str:
        for pair, symbol in self.rules:
            run = run.replace(pair, symbol)
        return run

    def matrix(self, run: str) -> Matrix:
        """The matrix of a run of symbols; those of runs met before are remembered."""
        out = self.known.get(run)
        if out is None:
            out = NO_ROWS
            for c in self.compress(run):
                out = after(out, self.of[c]) if out is not NO_ROWS else self.of[c]
            out = [[x and (x[0], spell(x[1])) for x in row] for row in out]
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[run] = out
        return out


def pair_counts(run: str) -> Counter:
    """Adjacent pairs of a run that can be replaced together: in a run of one symbol every other one."""
    out, skip = Counter(), False
    for x, y in zip(run, run[1:]):
        if x == y and skip:
            skip = False
            continue
        out[x + y] += 1
        skip = x == y
    return out


def grammar(runs: DataFrame, max_rules: int = MAX_RULES) -> list[tuple[str, str]]:
    """Re-Pair rules of a table of runs (symbols, n).  A round counts pairs over all runs as far as they are compressed and
    makes rules of the most frequent ones that share no symbol, so that their order does not matter."""
    rules: list[tuple[str, str]] = []
    runs = runs.coalesce(runs.count() // RUNS + 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, seen = Grammar([]), Counter()
        made.rules = rules
        for batch in batches:
            for run, n in zip(batch["symbols"], batch["n"]):
                for pair, k in pair_counts(made.compress(run)).items():
                    seen[pair] += k * int(n)
            if len(seen) > 100_000:
                yield pd.DataFrame(seen.items(), columns=["pair", "k"])
                seen.clear()
        yield pd.DataFrame(seen.items(), columns=["pair", "k"])

    for _ in range(MAX_ROUNDS):
        counted = runs.mapInPandas(count, "pair string, k long").groupBy("pair").agg(F.sum("k").alias("k")).filter("k > 1")
        used: set[str] = set()
        for r in counted.orderBy(F.desc("k"), "pair").limit(64).collect():
            if len(rules) < max_rules and not used & set(r.pair):
                used |= set(r.pair)
                rules = [*rules, (r.pair, chr(0xE000 + len(rules)))]
        if not used:
            break
    return rules


def damage(turns: DataFrame) -> DataFrame:
    """The rows conv_id, turn, role, text with one of the faults that op13 names; m: how often a row is there (0: dropped)."""
    text_of = lambda name: F.coalesce(col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    role, text = text_of("role"), text_of("text")
    return turns.select(
        col("conv_id").cast("long").alias("conv_id"),
        col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("m"),
    )


def _pieces(size: int):
    """Sorted turns of a partition as pieces of conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, out, now = TaskContext.get().partitionId(), object(), [], None

        def close() -> None:
            if now:
                now["symbols"], now["roles"] = "".join(now["symbols"]), "".join(now["roles"])
                r = now.pop("roles")
                now["illegal"] = sum(r[i : i + 2] not in ("su", "ua", "au") for i in range(len(r) - 1))
                now["head"], now["tail"] = r[:1], r[-1:]
                out.append(now)

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != at or now is None:
                    close()
                    at, now, number = row["conv_id"], None, 0
                copies, turn = row["m"], row["turn"]
                while now is None or copies:
                    if now is None or len(now["symbols"]) >= size:
                        if now:
                            close()
                            number += 1
                        now = {"conv_id": at, "part": part, "number": number, "symbols": [], "roles": [], "blank": 0, "duplicate": 0, "truncated": 0, "least": None, "most": None, "turns": 0}
                    if not copies:
                        break
                    if turn is not None and now["most"] != turn:
                        now["least"] = turn if now["least"] is None else now["least"]
                        now["most"], now["turns"] = turn, now["turns"] + 1
                    again = not row["first"] or copies < row["m"]
                    fault = "blank" if row["blank"] else "duplicate" if again else "truncated" if row["cut"] else None
                    if fault:
                        now[fault] += 1
                    role = row["role"][:1] if row["role"][:1] in ("s", "u", "a") else "o"
                    now["roles"].append(role)
                    now["symbols"].append("d" if fault in ("blank", "duplicate") else role.upper() if fault else role)
                    copies -= 1
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=PIECES)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=PIECES)

    return run


PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("number", pa.int64()), ("symbols", pa.string()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "least", "most", "turns")], ("head", pa.string()), ("tail", pa.string())])
_PIECES = "conv_id long, part long, number long, symbols string, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, head string, tail string"


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def pieces(rows: DataFrame, size: int = PIECE) -> DataFrame:
    """Pieces of all conversations; rows: conv_id, turn, role, text, m.

    Turns go by turn (null first), then role, then the text's MD5.  Rows that agree in all of it are merged before they
    are shuffled; which of them is the first of its role and text in the conversation is found by minima.
    """
    text = F.btrim("text", F.lit(SPACES))
    slim = rows.select("conv_id", "turn", "role", digest_of(F.col("text")).alias("h"), (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("cut"), "m")
    once = checkpointed(slim.groupBy("conv_id", "turn", "role", "h", "blank", "cut").agg(F.sum("m").alias("m")))
    first = once.filter("m > 0").groupBy("conv_id", "role", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("k"), "turn")).alias("t"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("x"), F.col("t.turn").alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("x"))
    known = once.join(first, same, "left").select("conv_id", "turn", "role", "h", "blank", "cut", "m", F.col("turn").eqNullSafe(F.col("t")).alias("first"))
    order = ["conv_id", "turn", "role", "h"]
    spread = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return known.repartitionByRange(spread, *order).sortWithinPartitions(*order).drop("h").mapInArrow(_pieces(size), _PIECES)


def _measured(rules: list[tuple[str, str]]) -> Callable:
    """Costs of each piece's matrix (-1: no way), and the place of each audit among those from the same state."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = Grammar(rules)
        for runs in batches:
            costs, ranks = [], []
            for run_ in runs:
                m = made.matrix(run_)
                costs.append([-1 if x is None else x[0] for row in m for x in row])
                ranks.append([r for row in m for r in _places([x and x[1] for x in row])])
            yield pd.DataFrame({"costs": costs, "ranks": ranks})

    return F.pandas_udf(run, "costs array<int>, ranks array<int>")


def _places(values: list) -> list[int]:
    order = sorted((v, i) for i, v in enumerate(values) if v is not None)
    out = [0] * len(values)
    for place, (_, i) in enumerate(order):
        out[i] = place
    return out


def shortest(matrices: list[tuple[list[int], list[int]]]) -> tuple[int, list[int]]:
    """(cost, states) of the cheapest way through the pieces, ties by least audit.  An audit is only compared by the places
    of its parts."""
    state: list = [(0, 0), None, None, None]
    back = []
    for costs, ranks in matrices:
        best: list = [None] * 4
        for j in range(4):
            for k in range(4):
                if state[k] is not None and costs[4 * k + j] >= 0:
                    new = (state[k][0] + costs[4 * k + j], (state[k][1], ranks[4 * k + j]), k)
                    if best[j] is None or new[:2] < best[j][:2]:
                        best[j] = new
        back.append([b and b[2] for b in best])
        place = _places([b and b[1] for b in best])
        state = [b and (b[0], place[j]) for j, b in enumerate(best)]
    ends = [(s[0] + INSERT * len(TAIL[j]), s[1], j) for j, s in enumerate(state) if s is not None]
    cost, _, j = min(ends, key=lambda e: e[:2])
    states = [j]
    for row in reversed(back):
        states.append(row[states[-1]])
    return cost, states[::-1]


def _shortest(lists: pd.Series) -> pd.DataFrame:
    found = [shortest([(p["costs"], p["ranks"]) for p in parts]) for parts in lists]
    return pd.DataFrame({"cost": [c for c, _ in found], "states": [s for _, s in found]})


def _spelled(rules: list[tuple[str, str]]) -> Callable:
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = Grammar(rules)
        for runs, before, then in batches:
            yield pd.Series([made.matrix(r)[i][j][1] for r, i, j in zip(runs, before, then)])

    return F.pandas_udf(run, "string")


def audits(rows: DataFrame, size: int = PIECE, max_rules: int = MAX_RULES) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit; rows: conv_id, turn, role, text, m.

    A conversation without turns (all m are 0) has zeros and an empty audit.
    """
    cut = checkpointed(pieces(rows, size))
    rules = grammar(checkpointed(cut.groupBy("symbols").agg(F.count(F.lit(1)).alias("n"))), max_rules)
    measured = cut.withColumn("m", _measured(rules)(F.col("symbols")))
    place = F.struct("part", "number", "head", "tail", "least", "most", F.col("m.costs").alias("costs"), F.col("m.ranks").alias("ranks"))
    # pieces of a conversation: one for PIECE turns or for a partition
    whole = measured.groupBy("conv_id").agg(F.sort_array(F.collect_list(place)).alias("parts"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("least").alias("least"), F.max("most").alias("most"))
    whole = checkpointed(whole.withColumn("way", F.pandas_udf(_shortest, "cost long, states array<int>")(F.col("parts"))))
    full = F.filter("parts", lambda p: p["head"] != "")
    joints = F.transform(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(1))), lambda p, i: F.struct(full[i].alias("a"), p.alias("b")))
    seams = F.size(F.filter(joints, lambda x: ~F.concat(x["a"]["tail"], x["b"]["head"]).isin("su", "ua", "au")))
    # a turn number that goes on in the next piece was counted in both
    dated = F.filter("parts", lambda p: p["least"].isNotNull())
    split = F.size(F.filter(F.transform(F.slice(dated, 2, F.greatest(F.size(dated) - 1, F.lit(1))), lambda p, i: dated[i]["most"] == p["least"]), lambda x: x))
    ways = whole.select("conv_id", F.posexplode("parts").alias("i", "p"), F.col("way.states").alias("s")).select(F.col("conv_id").alias("c"), F.col("p.part").alias("part"), F.col("p.number").alias("number"), F.col("s")[F.col("i")].alias("before"), F.col("s")[F.col("i") + 1].alias("then"))
    spelt = cut.select("conv_id", "part", "number", "symbols").join(ways, ["part", "number"]).filter(F.col("conv_id").eqNullSafe(F.col("c")))
    spelt = spelt.select("conv_id", F.struct("part", "number", _spelled(rules)(F.col("symbols"), F.col("before"), F.col("then")).alias("audit")).alias("a"))
    joined = spelt.groupBy(F.col("conv_id").alias("c")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("a")), lambda x: x["audit"]), "").alias("audit"))
    counts = whole.select("conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns") + split, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + seams).cast("long").alias("illegal"), F.col("way.cost").alias("cost"), F.element_at(F.array(*map(F.lit, TAIL)), F.element_at("way.states", -1) + 1).alias("end"))
    out = counts.join(joined, F.col("conv_id").eqNullSafe(F.col("c")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("audit", "end").alias("audit"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Audits and turns in order -> ("open", header) of each conversation and ("turn", role, text, edit) of what stays."""
    letters, state = iter(()), 0

    def inserted(letter: str) -> tuple:
        nonlocal state
        role, state = NAMES[FORCED[state]], NEXT[FORCED[state]][state]
        return "turn", role, "", letter

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                yield from (inserted(x) for x in letters)
                letters, state = iter(row["audit"]), 0
                yield "open", row
                continue
            for _ in range(row["m"]):
                letter = next(letters)
                while letter == "I":
                    yield inserted(letter)
                    letter = next(letters)
                if letter == "R":
                    yield inserted(letter)[:2] + (row["text"], letter)
                elif letter == "K":
                    state = NEXT[row["role"][:1]][state]
                    yield "turn", row["role"], row["text"], letter
    yield from (inserted(x) for x in letters)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, out, at, i = ["conv_id", "position", "role", "text", "edit"], [], None, 0
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    for kind, *what in _replayed(batches):
        if kind == "open":
            at, i = what[0]["conv_id"], 0
            continue
        out.append((at, i, *what))
        i += 1
        if len(out) >= 1000:
            yield give()
            out.clear()
    if out:
        yield give()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out, head, sha, empty = [], None, None, True

    def close() -> None:
        if head:
            out.append({**{n: head[n] for n in ("conv_id", *COUNTS, "audit")}, "repaired_sha256": sha.hexdigest()})

    for kind, *what in _replayed(batches):
        if kind == "open":
            close()
            head, sha, empty = what[0], hashlib.sha256(), True
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()
            continue
        role, text, _ = what
        sha.update((("" if empty else "\n") + f"{role}:{text}").encode())
        empty = False
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _replay(rows: DataFrame, edits: DataFrame, run: Callable, schema: str) -> DataFrame:
    nothing = {n: F.lit(None) for n in ("turn", "role", "h", "text", "m")}
    heads = edits.withColumns(nothing).withColumn("kind", F.lit(0))
    there = rows.filter("m > 0").withColumn("h", digest_of(F.col("text"))).withColumns({n: F.lit(None) for n in (*COUNTS, "audit")}).withColumn("kind", F.lit(1))
    both = heads.unionByName(there)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h").drop("kind", "h", "turn").mapInArrow(run, schema)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, position, role, text and the edit that put each there (K, R or I);
    rows: conv_id, turn, role, text, m; edits: what audits makes of them."""
    return _replay(rows, edits, _turns, "conv_id long, position long, role string, text string, edit string")


def op13_repair(turns: DataFrame) -> DataFrame:
    """All conversations, damaged and repaired: counts of faults, cost, audit and the digest of what comes out.

    Nulls in role and text are one space, a null conv_id is a conversation of its own, null turns come first; rows of one
    turn go by role, then by their text's MD5, so repeated rows are neighbours and all but the first are duplicates.  A
    conversation without rows after damage has zeros; an empty table gives an empty one; further columns are ignored.
    """
    rows = damage(turns)
    return _replay(rows, audits(rows), _digests, f"conv_id long, {', '.join(f'{n} long' for n in COUNTS)}, audit string, repaired_sha256 string")
