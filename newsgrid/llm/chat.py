"""Chat formatting in budgeted windows.

Each turn costs the tokens of its formatted form, marks, role and escapes included; as the tokenizer never joins across a
line end, a window has as many tokens as its turns together.  Prefix sums of these costs within a conversation put the turns into
bins of `new` tokens by where they start; the turns of a bin are one window.  A window starts with the conversation's
system turn, then repeats the turns that start in the last `history` tokens before the bin, then holds its own turns.
Only assistant texts among its own turns are under the loss mask, so each is a target once.

A window's tokens are bounded by the system turn + 2 * history + new + the last turn's own; a turn is never cut, so
one that is longer than all of that stands alone with its context.

Control strings inside roles and texts are escaped reversibly: a backslash is doubled and the first character of a
control string becomes a backslash escape.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgrid.llm.common import checkpointed, col, text_batches, text_or_empty
from newsgrid.llm.packing import _encode

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that a tokenizer may take for control tokens (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
NEW, HISTORY = 1024, 256
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c[0]):04x}{c[1:]}"))
    return out


def name_of(role: Column) -> Column:
    """A role as it stands in its own line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|n|u[0-9a-f]{4})", lambda m: {"\\": "\\", "n": "\n"}.get(m[1]) or chr(int(m[1][1:], 16)), text)


def _counts(path: str):
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([len(ids) // 4 for ids in _encode([t or "" for t in text], path)], dtype="int64")

    return run


def token_count(text: Column, path: str | None = None) -> Column:
    return F.pandas_udf(_counts(path or public_tokenizers.path("word_bpe_49k.json")), T.LongType())(text)


def windows(turns: DataFrame, new: int = NEW, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """One row per window: conv_id, window, formatted, tokens, turn_spans, loss_spans.

    turn_spans are (start, end) of the window's own turns in `formatted`, loss_spans those of its targets, both in code
    points.  Turns go by turn number (null first), then role, then text; a null text or role is empty; a null conv_id
    is a conversation of its own.  history must not exceed new.
    """
    if history > new:
        raise ValueError("history must not exceed new")
    rows = turns.select(F.coalesce(col("conv_id"), F.lit(0)).cast("long").alias("c"), col("conv_id").isNull().alias("cn"), F.coalesce(col("turn").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("t"), text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    cost = token_count(F.concat(F.lit(OPEN), name_of(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE)), path)
    with text_batches(turns.sparkSession):
        rows = checkpointed(rows.withColumn("cost", cost).withColumn("chunk", F.shiftright("t", 8)))
    # prefix sums in two levels, so that a very long conversation is not summed in one task
    key = ["c", "cn"]
    before = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "chunk").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"))
    starts = sums.select(*key, "chunk", F.coalesce(F.sum("cost").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"))
    inside = Window.partitionBy(*key, "chunk").orderBy("t", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, [*key, "chunk"]).withColumn("start", F.col("base") + F.coalesce(F.sum("cost").over(inside), F.lit(0))).withColumn("rank", F.col("base_n") + F.count(F.lit(1)).over(inside))
    own = F.call_function("div", F.col("start"), F.lit(new).cast("long"))
    edge = (F.col("own") + 1) * new
    repeats = (F.col("start") >= edge - history) & (F.col("start") + F.col("cost") <= edge + history)
    placed = placed.withColumn("own", own).select(*key, "rank", "role", "text", "cost", F.explode(F.when(repeats, F.array(F.struct(F.col("own").alias("w"), F.lit(True).alias("mine")), F.struct((F.col("own") + 1).alias("w"), F.lit(False).alias("mine")))).otherwise(F.array(F.struct(F.col("own").alias("w"), F.lit(True).alias("mine"))))).alias("at"))
    turn = F.struct("rank", F.col("at.mine").alias("mine"), "role", "text", "cost")
    placed = checkpointed(placed.select(*key, F.col("at.w").alias("window"), turn.alias("turn")))
    system = placed.filter("turn.role = 'system' AND turn.mine").groupBy(*key).agg(F.min("turn").alias("system"))
    # a window's turns: at most (new + 2 * history) / 14, the marks alone having so many tokens
    packed = placed.groupBy(*key, "window").agg(F.sort_array(F.collect_list("turn")).alias("turns")).filter(F.exists("turns", lambda x: x["mine"]))
    packed = packed.join(system, key, "left")
    there = F.exists("turns", lambda x: x["rank"] == F.col("system")["rank"])
    head = F.when(F.col("system").isNull() | there, F.array().cast(packed.schema["turns"].dataType)).otherwise(F.array(F.col("system").withField("mine", F.lit(False))))
    packed = packed.withColumn("turns", F.concat(head, F.col("turns")))
    packed = packed.withColumn("parts", F.transform("turns", lambda x: F.struct(F.concat(F.lit(OPEN), name_of(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), x["mine"].alias("mine"), (x["mine"] & (x["role"] == "assistant")).alias("loss"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,body:int,stop:int,end:int,mine:boolean,loss:boolean>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        body = s["at"] + F.length(x["head"])
        stop = body + F.length(x["body"])
        end = stop + len(CLOSE)
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), body.alias("body"), stop.alias("stop"), end.alias("end"), x["mine"].alias("mine"), x["loss"].alias("loss")))).alias("spans"))

    packed = packed.withColumn("spans", F.aggregate("parts", zero, step, lambda s: s["spans"]))
    return packed.select(
        F.when(~F.col("cn"), F.col("c")).alias("conv_id"),
        "window",
        F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + x["cost"]).alias("tokens"),
        F.transform(F.filter("spans", lambda s: s["mine"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("turn_spans"),
        F.transform(F.filter("spans", lambda s: s["loss"]), lambda s: F.struct(s["body"].alias("start"), s["stop"].alias("end"))).alias("loss_spans"),
    )


def read_window(formatted: str, turn_spans: list, loss_spans: list) -> tuple[list[tuple[str, str]], list[str]]:
    """The window's own turns (role, text) and the texts under its loss mask, unescaped."""
    turns = []
    for s in turn_spans:
        head, _, body = formatted[s["start"] + len(OPEN) : s["end"] - len(CLOSE)].partition("\n")
        turns.append((unescape(head), unescape(body)))
    return turns, [unescape(formatted[s["start"] : s["end"]]) for s in loss_spans]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (conv_id, window, formatted, turn_spans, loss_spans) in order: the digests of each conversation, held one at a time."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    at, state, out = object(), None, []

    def close() -> None:
        if state:
            out.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != at:
                close()
                at, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            turns, targets = read_window(row["formatted"], row["turn_spans"], row["loss_spans"])
            for role, text in turns:
                state[1].update(f"{role}\n{text}\n".encode())
            for text in targets:
                state[2] += len(text)
                state[3].update(text.encode())
            state[0] += len(turns)
            state[4] += len(row["formatted"])
            state[5] += 1
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted windows say, read back, per conversation.  A digest runs over the whole conversation, so its
    windows pass one after the other through one task, which holds one window at a time."""
    ordered = formatted.select("conv_id", "window", "formatted", "turn_spans", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op2_chat(turns: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted and read back.

    A null text or role is empty, a null conv_id is a conversation of its own, null turns come first; rows of one turn go by
    role, then text, and repeated rows are turns of their own.  An empty table gives conversation -1 alone.
    """
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    every = turns.select(col("conv_id").cast("long"), col("turn").cast("long"), "role", "text").union(probe)
    return digests(windows(every))
