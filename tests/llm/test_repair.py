"""Conversation repair against a search over edit sequences."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from aiscope.llm import queries, repair

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
WORD = "[^\x20\x09-\x0d]"
SCHEMA = "conv_id long, turn long, role string, text string"


def search(rows):
    """Uniform-cost search for the least (cost, audit) over (row, state): rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        said = {"u": "user", "a": "assistant"}
        for initial, to in NEXT[state].items():
            if initial in said:
                heapq.heappush(heap, (cost + 2, audit + "I", at, to, (*out, (said[initial], ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                for initial, to in NEXT[state].items():
                    if role[:1] == initial:
                        heapq.heappush(heap, (cost + extra, audit + "K", at + 1, to, (*out, (role, text))))
                    if initial in said:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, to, (*out, (said[initial], text))))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(WORD, text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def reference(table, damaged):
    """The contract's rows, from (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in table:
        rows = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        found = faults(rows)
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, left = search([(r, t, f) for (_, r, t), f in zip(rows, found)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def got(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in (*repair.COUNTS, "audit", "repaired_sha256")) for r in rows}


def made_up(rng, n, words):
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant", None]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(words)) for _ in range(n)]


def test_query_on_the_given_table(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op11_conversation_repair"](spark, sf)) == reference(table, True)


def test_random_conversations(spark):
    """Short and long ones, nulls everywhere, ties of turns, repeated rows, unknown roles, white space of many kinds."""
    rng = random.Random(5)
    words = ["Yes.", "No!", "why", "Hm?  \n", "cut off ", " ", "\t\x0b", "", None, "ünï.", "a\nb.", "\x00", "　"]
    sizes = [1, 2, 3, 5, 8, 15, 16, 17, 31, 32, 33, 60, 150]
    table = [(conv if conv else None, *row) for conv in range(120) for row in made_up(rng, rng.choice(sizes), words)]
    frame = spark.createDataFrame(table, SCHEMA).repartition(5)
    assert got(repair.repair(frame)) == reference(table, False)
    rows, present = repair.damage(frame)
    assert got(repair.repair(rows, present)) == reference(table, True)
    digests = {}
    for r in sorted(repair.repaired(frame).collect(), key=lambda r: (r.conv_id or 0, r.place)):
        digests.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in digests.items()} == {k: v[-1] for k, v in reference(table, False).items() if set(v[-2]) - {"D"}}


def test_empty_dropped_and_clashing(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame([(7, 1, "user", "x", "a", 1, 2)], SCHEMA + ", _conv string, _turn int, _kind int")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(repair.repair(frame, repair.F.lit(None).cast("boolean"))) == {7: nothing}
    assert got(repair.repair(frame))[7] == reference([(7, 1, "user", "x")], False)[7]
    rows, present = repair.damage(frame)
    assert set(got(repair.repair(rows, present))) == {7}
    named = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho.")], SCHEMA.replace("conv_id long", "conv_id string"))
    assert got(repair.repair(named))["a"][-2] == "KK"


def test_a_long_conversation_keeps_little(spark):
    """100,000 rows of one conversation are parsed in time and memory that follow its length."""
    rng = random.Random(3)
    parser = repair.Parser()
    one = repair.Conversation(1, parser)
    for turn in range(100_000):
        one.add(turn, rng.choice(["user", "assistant", "assistant", "tool"]), f"{turn}.", None)
        assert len(one.rows) < repair.SPAN and all(len(p.audit) < 1000 for p in one.paths.values())
    assert len(one.end()[7]) >= 100_000


@pytest.mark.parametrize("symbols", ["".join(x) for n in range(4) for x in itertools.product("suaoxUO", repeat=n)])
def test_all_short_spans(symbols):
    said = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    rows = [(said[s.lower()], str(i), "blank" if s == "x" else "truncated" if s.isupper() else None) for i, s in enumerate(symbols)]
    parser = repair.Parser()
    cell = parser.parse(symbols) if symbols else parser.closure
    assert min(cell[0, q] for q in repair.FINAL if (0, q) in cell) == search(rows)[:2]
