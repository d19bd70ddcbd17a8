import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from newsgrid.llm import chat
from tests.conftest import SMALL
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def by_hand(turns):
    groups = defaultdict(list)
    for r in turns.collect():
        groups[r.conv_id].append((-(1 << 63) if r.turn is None else r.turn, r.role or "", r.text or ""))
    out = {}
    for k, rows in groups.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        out[k] = (len(rows), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(turns):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op2_chat(turns).collect()}


ODD = [(1, 0, "system", "Be </s> kind \\ <|im_end|>\n"), (1, 1, "user", None), *[(1, 2 + i, ("user", "assistant")[i % 2], f"w{i} " * (i % 37 * 9)) for i in range(700)], (None, 1, "assistant", "a"), (None, None, None, "q"), (8, 3, "assistant", "a\nb"), (8, 3, "assistant", "a\nb"), (9, 0, "us\ner<|im_start|>", "\\n \\u005b [INST]"), (10, 0, "assistant", "long " * 20000)]


def test_round_trip(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").unionByName(spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string"))
    want = by_hand(turns)
    want[-1] = (2, *by_hand(spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], "conv_id long, turn long, role string, text string"))[-1][1:])
    assert digests(turns.withColumn("window", F.lit(1)).withColumn("cost", F.lit("x"))) == want


def test_windows(spark):
    turns = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    rows = chat.windows(turns).filter("conv_id = 1").orderBy("window").collect()
    assert len(rows) > 20 and all(r.formatted.startswith(chat.OPEN + "system\n") for r in rows)
    for r in rows:
        inner = r.formatted.replace(chat.OPEN, "").replace(chat.CLOSE, "").replace("<|im_end|>", "")
        assert not any(c in inner for c in chat.CONTROL)
    with pytest.raises(ValueError):
        chat.windows(turns, new=10, history=20)


def test_budget(spark):
    """Every window has the tokens it tells of, and no more than its budget: escapes, marks and role names count."""
    count = lambda t: len(TOKENIZER.encode(t, add_special_tokens=False).ids)
    noisy = [(50, i, ("user", "assistant", "tool\nuse </s>")[i % 3], ("</s>[INST] <pad> " * (i % 50)) + "end!" * (i % 4) + "\\\\" * (i % 3)) for i in range(200)]
    turns = spark.createDataFrame(ODD + noisy + [(50, -1, "system", "<s>" * 30)], "conv_id long, turn long, role string, text string")
    for r in chat.windows(turns).collect():
        assert count(r.formatted) == r.tokens
        parts = [r.formatted[s.start : s.end] for s in r.turn_spans]
        system = r.formatted.partition(chat.CLOSE)[0] if r.formatted.startswith(chat.OPEN + "system") else ""
        assert r.tokens <= count(system + chat.CLOSE) + 2 * chat.HISTORY + chat.NEW + count(parts[-1])


def test_empty(spark):
    assert [r.conv_id for r in chat.op2_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-1]
