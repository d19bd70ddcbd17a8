import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from newsgrid.llm import variants
from newsgrid.llm.queries import ORACLE_SQL
from tests.conftest import SMALL


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(counts):
    words, out = sorted(counts), {}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def counted(rows):
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def rows_of(df):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def alike(rng, n, letters="abcde"):
    """Distinct words many of which are one edit apart."""
    out = set()
    while len(out) < n:
        word = "".join(rng.choice(list(letters), int(rng.integers(6, 10))))
        out.add(word)
        for _ in range(4):
            i, c = int(rng.integers(len(word))), str(rng.choice(list(letters)))
            out.add([word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word[:i] + word[i + 1 :]][int(rng.integers(3))])
    return sorted(w for w in out if len(w) >= 6)


@pytest.mark.parametrize("split", [7, 100, 8192])
def test_all_pairs(spark, split):
    rng = np.random.default_rng(2)
    counts = {w: int(5 * 6 ** rng.integers(0, 6) + rng.integers(3)) for w in alike(rng, 700) + ["é" * 6, "é" * 7, "\U0001f600éàüöä", "\U0001f600éàüöö", "x" * 3000, "x" * 1200 + "y" + "x" * 1799]}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = by_hand(counts)
    assert sum(v[3] for v in want.values()) > 1000 and len({v[1] for v in want.values() if v[0] not in (None, v[1])}) > 3
    assert rows_of(variants.variants(df, split=split)) == want


def test_large_groups_over_many_blocks(spark):
    """All words share their first half, far more of them than a block holds."""
    rng = np.random.default_rng(3)
    counts = {"abc" + w: int(rng.integers(5, 5000)) for w in {"".join(rng.choice(list("abcdefgh"), 4)) for _ in range(1500)}}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants.variants(df)) == by_hand(counts)


def test_documents(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for table in (docs, odd):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        got = rows_of(variants.op11_variants(table))
        con = duckdb.connect()
        con.register("documents", table.select("doc_id", "text").toArrow())
        sql = con.execute(f"SELECT word, form, root, n, n_near, form_n FROM ({ORACLE_SQL['op11_variants']})").fetchall()
        assert {r[0]: r[1:] for r in sql} == got and len(sql) == len(got)
        assert {w: v[2] for w, v in got.items()} == counted(rows)


def test_runs_and_case(spark):
    rows = [(i, t) for i in range(400) for t in ("ÉCOLEÉ École_ecoles x×yzzyzz", "Straßen-WORDS wordswordsıword", None)]
    df = spark.createDataFrame([*rows, (None, "nullnull " * 5)], "doc_id long, text string")
    want = by_hand(counted([*rows, (None, "nullnull " * 5)]))
    assert rows_of(variants.op11_variants(df)) == want and "ÉcoleÉ" in want and "x×yzzyzz" in want


def test_empty(spark, none):
    assert variants.op11_variants(none).count() == 0 and variants.op11_variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]
