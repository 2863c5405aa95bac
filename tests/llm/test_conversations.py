import hashlib
import heapq
import itertools
import random
import time
import zlib

import duckdb
import pytest
from clarispan.llm import conversation_repair as repair
from clarispan.llm.conversation_repair import SQL, op13_conversation_repair, parse

SF = "/root/testdata/sf0.1"
NEXT = {"b": ("u", "u"), "s": ("u", "u"), "u": ("a", "p"), "p": ("u", "u")}


def cheapest(rows):
    """Least (cost, audit, what was done) by Dijkstra over whole audits. Rows: (initial, must go, truncated)."""
    heap, best, tie = [(0, "", 0, 0, "b", ())], {}, itertools.count(1)
    while heap:
        cost, audit, _, i, state, done = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = cost
        if i == len(rows) and state in "bp":
            return cost, audit, done
        wanted, to = NEXT[state]
        heapq.heappush(heap, (cost + 3, audit + "I", next(tie), i, to, (*done, ("I", wanted))))
        if i < len(rows):
            initial, gone, late = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", next(tie), i + 1, state, (*done, ("D", ""))))
            if not gone and initial == "s" and state == "b":
                heapq.heappush(heap, (cost + 3 * late, audit + "K", next(tie), i + 1, "s", (*done, ("K", ""))))
            if not gone:
                kept = initial == wanted
                heapq.heappush(heap, (cost + 3 * late + (0 if kept else 3), audit + ("K" if kept else "R"), next(tie), i + 1, to, (*done, ("K" if kept else "R", wanted))))


def letter(row):
    initial, gone, late = row
    return "x" if gone else ("_" if late else "-") if initial not in "sua" else initial.upper() if late else initial


def test_parse_equals_all_repairs():
    pick = random.Random(1)
    kinds = [(i, False, late) for i in "sua-" for late in (False, True)] + [("u", True, False)]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert parse("".join(map(letter, rows))) == cheapest(rows)[:2]
    for _ in range(4000):
        rows = pick.choices(kinds, weights=[1, 1, 5, 1, 5, 1, 1, 1, 2], k=pick.randrange(4, 40))
        assert parse("".join(map(letter, rows))) == cheapest(rows)[:2]


def test_long_conversations_take_linear_time():
    began = time.time()
    assert parse("u" * 100_000)[0] == 150_000 and parse("ua" * 50_000) == (0, "K" * 100_000)
    assert time.time() - began < 60


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spelt = [" " if x is None else str(x) for x in (conv, turn)]
        code = zlib.crc32(":".join(spelt).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else text.translate(str.maketrans("", "", ".!?")) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def brute(rows):
    out = set()
    damaged = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        faults, seen, tokens = [0, 0, 0], set(), []
        for _, _, role, text in mine:
            said = text.rstrip(repair.BLANK)
            fault = 0 if not said else 1 if (role, text) in seen else 2 if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            tokens.append((role[:1] or "-", fault in (0, 1), fault == 2))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, done = cheapest(tokens)
        rest, made = iter(mine), []
        for what, wanted in done:
            row = None if what == "I" else next(rest)
            if what != "D":
                made.append(({"u": "user", "a": "assistant"}[wanted] if what in "IR" else row[2]) + ":" + ("" if what == "I" else row[3]))
        out.add((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


def query_over(spark, rows, monkeypatch):
    frame = spark.createDataFrame([(*r, 7, "c") for r in rows], "conv_id long, turn long, role string, text string, seq int, `dropped` string").repartition(3)
    monkeypatch.setattr(repair, "table", lambda *_: frame)
    return [tuple(r) for r in op13_conversation_repair(spark, "").collect()]


def test_query_equals_brute_force(spark, monkeypatch):
    pick = random.Random(5)
    words = ["", " ", "\t\r\n", "Yes.", "No", "Why?\x0b ", "x" * 300 + "!", "Ja.", "日本。", "é. ", ".", None, "a b"]
    rows = []
    for conv in [*range(60), None, -3]:
        for turn in range(pick.randrange(1, 14)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "agent", "umpire"])
            rows.append((conv, pick.choice([turn, turn, turn, turn * 3, None, -turn]), role, pick.choice(words)))
    rows += rows[10:14] + [(1 << 62, -(1 << 60), "user", "Hi.")]
    alone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((alone, 0, "user", "All of this conversation is dropped."))
    got = query_over(spark, rows, monkeypatch)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert (alone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_a_conversation_with_most_of_the_rows(spark, monkeypatch):
    pick = random.Random(6)
    rows = [(7, i, pick.choice(["user", "user", "assistant"]), f"Turn {i}{pick.choice(['.', ''])}") for i in range(9000)] + [(i, j, "user", "Hi.") for i in range(100, 160) for j in range(3)]
    got = {r[0]: r for r in query_over(spark, rows, monkeypatch)}
    assert got[7] in brute([r for r in rows if r[0] == 7]) and len(got) == 61


def test_empty_table(spark, monkeypatch):
    assert query_over(spark, [(1, 1, "user", "x")], monkeypatch)
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(repair, "table", lambda *_: frame)
    assert op13_conversation_repair(spark, "").count() == 0


def test_repaired_turns_are_whole_conversations(spark):
    rows = repair.prepared(spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (2, 0, "system", "S."), (2, 1, "assistant", "D.")], "conv_id long, turn long, role string, text string"))
    turns = repair.repaired_turns(rows, repair.repairs(rows))
    assert sorted((r.conv, r.seq, r.role, r.text) for r in turns.collect()) == [(1, 0, "user", "A."), (1, 1, "assistant", ""), (1, 2, "user", "B."), (1, 3, "assistant", "C."), (2, 0, "system", "S."), (2, 1, "user", ""), (2, 2, "assistant", "D.")]


@pytest.mark.parametrize("sf", [SF])
def test_whole_table_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({SQL})").fetchall()
    assert sorted(map(tuple, op13_conversation_repair(spark, sf).collect())) == sorted(rows) and len(rows) == 1000
