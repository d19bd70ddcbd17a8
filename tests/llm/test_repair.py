import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import duckdb
import numpy as np
import pytest

from newsgrid.llm import repair
from newsgrid.llm.queries import ORACLE_SQL
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
DUE = {0: "u", 1: "u", 2: "a", 3: "u"}


def cheapest(symbols):
    """(cost, edits) of a run of symbols, by trying every edit from the end."""
    @lru_cache(None)
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(symbols) and state in (0, 3) else []
        if inserts < 2:
            c, a = best(i, NEXT[state, DUE[state]], inserts + 1)
            ways.append((c + 3, "I" + a))
        if i < len(symbols):
            s = symbols[i]
            c, a = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a))
            if s != "d":
                extra = 3 * s.isupper()
                c, a = best(i + 1, NEXT[state, DUE[state]], 0)
                ways.append((c + 3 + extra, "R" + a))
                if (state, s.lower()) in NEXT:
                    c, a = best(i + 1, NEXT[state, s.lower()], 0)
                    ways.append((c + extra, "K" + a))
        return min(ways, default=(10**9, ""))

    for i in range(len(symbols), 0, -1):  # from the end, so that no call goes deep
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def by_hand(rows):
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.md5(text.encode()).digest(), text)
        groups[c] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for c, g in groups.items():
        g.sort()
        seen, symbols, faults = set(), "", Counter()
        for _, _, role, _, text in g:
            tail = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            r = role[:1] if role[:1] in tuple("sua") else "o"
            symbols += "d" if fault in ("blank", "duplicate") else r.upper() if fault else r
        cost, audit = cheapest(symbols)
        turns = [t for known, t, *_ in g if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(g, g[1:]))
        state, lines, left = 0, [], iter(g)
        for e in audit:
            if e == "I":
                role, text = {"u": "user", "a": "assistant"}[DUE[state]], ""
            else:
                _, _, role, _, text = next(left)
            if e == "D":
                continue
            if e == "R":
                role = {"u": "user", "a": "assistant"}[DUE[state]]
            state = NEXT[state, role[:1]]
            lines.append(f"{role}:{text}")
        assert next(left, None) is None and state in (0, 3)
        out[c] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = (*repair.COUNTS, "audit", "repaired_sha256")
ODD = [
    *[(1, i, ("user", "assistant")[i % 2], f"turn {i % 41}{'.' if i % 7 else ''}") for i in range(900)], (2, 0, None, None), (2, None, "user", "Hi."), (2, None, "user", "Hi."), (None, 3, "assistant", "a."), (None, None, "user", "q?"),
    (3, 1, "", "x."), (3, 1, "tool", "y!"), (3, 5, "system", "z"), (3, 9, "assistant", " \n"), (4, 0, "user", "w. " * 20000), (4, 0, "user", "w. " * 20000), *[(5, 7, "user", "same.")] * 50, *[(6, 7, "assistant", f"t{i}.") for i in range(60)],
    *[(100 + c, 0, "user", "only.") for c in range(60)], *[(200 + c, t, ("system", "user", "assistant", "user")[t], f"{c} {t}.") for c in range(40) for t in range(4)],
]


def test_cheapest_edits_of_all_short_runs():
    """Matrices put together by rules, in any cut, give the cheapest and least edits."""
    rules = [("ua", ""), ("", ""), ("dd", ""), ("oS", ""), ("Ua", "")]
    made, plain = repair.Grammar(rules), repair.Grammar([])
    for n in range(5):
        for run in map("".join, product("dsuaoSUA", repeat=n)):
            want = cheapest(run)
            for g in (made, plain):
                found = []
                for j, end in enumerate(repair.TAIL):
                    x = g.matrix(run)[0][j] if run else (repair.NO_ROWS[0][j])
                    found += [(x[0] + 3 * len(end), x[1] + end)] if x else []
                assert min(found) == want, run


def test_pieces_agree_with_the_whole():
    rng, g = np.random.default_rng(4), repair.Grammar([("ua", ""), ("u", "")])
    for _ in range(300):
        run = "".join(rng.choice(list("dsuaoSUAO"), int(rng.integers(1, 40))))
        cuts = sorted({0, len(run), *rng.integers(0, len(run) + 1, 3).tolist()})
        parts = [g.matrix(run[a:b]) for a, b in zip(cuts, cuts[1:])]
        cost, states = repair.shortest([([-1 if x is None else x[0] for row in m for x in row], [r for row in m for r in repair._places([x and x[1] for x in row])]) for m in parts])
        audit = "".join(m[i][j][1] for m, i, j in zip(parts, states, states[1:])) + repair.TAIL[states[-1]]
        assert (cost, audit) == cheapest(run)


def test_grammar(spark):
    runs = spark.createDataFrame([("uaua", 5), ("suaua", 3), ("uuuuu", 2), ("d", 9)], "symbols string, n long")
    rules = repair.grammar(runs)
    assert rules[0][0] == "ua" and len({s for _, s in rules}) == len(rules)
    made = repair.Grammar(rules)
    whole = {s: p for p, s in rules}

    def expand(s):
        return "".join(expand(whole[c]) if c in whole else c for c in s)

    assert len(made.compress("uaua")) == 1 and all(expand(made.compress(r)) == r for r in ("uaua", "suaua", "uuuuu", "dsuad"))
    assert len(repair.grammar(runs, 1)) == 1 and repair.grammar(runs.limit(0)) == []


@pytest.mark.parametrize("which", ["table", "odd"])
def test_against_hand(spark, which):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet") if which == "table" else spark.createDataFrame(ODD, SCHEMA)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    want = {c: v for c, v in by_hand(rows).items()}
    got = repair.op13_repair(turns.selectExpr("*", "1 AS m", "'x' AS audit")).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)
    con = duckdb.connect()
    con.register("conversations", turns.toArrow())
    sql = con.execute(ORACLE_SQL["op13_repair"]).fetchall()
    assert {r[0]: r[1:] for r in sql} == want


def test_small_pieces_and_real_turns(spark):
    """Conversations cut into pieces of three turns give the same, and the repaired turns follow the grammar."""
    turns = spark.createDataFrame(ODD, SCHEMA)
    rows, want = repair.damage(turns), by_hand(ODD)
    edits = repair.checkpointed(repair.audits(rows, size=3, max_rules=5))
    assert {r.conv_id: tuple(r[c] for c in COLUMNS[:-1]) for r in edits.collect()} == {c: v[:-1] for c, v in want.items()}
    by = defaultdict(list)
    for r in repair.repaired(rows, edits).collect():
        by[r.conv_id].append((r.position, r.role, r.text))
    for c, w in want.items():
        lines = sorted(by[c])
        assert [p for p, *_ in lines] == list(range(len(lines))) and re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in lines))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest() == w[-1]


def test_empty(spark):
    assert repair.op13_repair(spark.createDataFrame([], SCHEMA)).count() == 0
