"""Conversation repair against plain recursion over whole conversations."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest

from seqwright.llm import conversations as C

from conftest import SF001

SCHEMA = "conv_id bigint, turn bigint, role string, text string, codes string, chunk int, nr int"
SEP = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        left = text.rstrip(SEP)
        faults.append("blank" if not left else "duplicate" if (role, text) in seen else "" if left[-1] in ".!?" else "truncated")
        seen.add((role, text))
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        """(cost, audit, lines) of the rest: state is the last initial."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        names = {"u": "user", "a": "assistant"}
        if inserts < 3:
            c, a, ls = best(i, due[state], inserts + 1)
            found.append((c + 2, "I" + a, (names[due[state]] + ":", *ls)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, ls = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, ls))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if role[:1] == due[state] or (role[:1] == "s" and state == ""):
                    c, a, ls = best(i + 1, role[:1], 0)
                    found.append((c + late, "K" + a, (f"{role}:{text}", *ls)))
                c, a, ls = best(i + 1, due[state], 0)
                found.append((c + late + 2, "R" + a, (f"{names[due[state]]}:{text}", *ls)))
        return min(found) if found else (10**9, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    ini = [r[1][:1] for r in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(ini, ini[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def awkward():
    rows = []
    for conv in [None, *range(60)]:
        k = zlib.crc32(str(conv).encode())
        for t in range(k % 9):
            role = ["system", "user", "assistant", "tool", "", None, "User", "assistant", "user"][(k >> t) % 9]
            text = ["Yes.", "no", "ok!", None, "", " \n", "What?", "Fine. ", "cut off", " ."][(k >> (t + 2)) % 10]
            turn = [t, t, t + 3, None, t // 2][(k >> 5) % 5]
            rows.append((conv, turn, role, text, "x", 1, 2))
    long_ = [(99, t, ["user", "assistant"][t % 2], f"line {t % 70}.", "x", 1, 2) for t in range(200)]
    blanks = [(98, None, "user", "", "x", 1, 2)] * 60                # one repeated row
    return rows + long_ + blanks + [rows[0]]


@pytest.mark.parametrize("chunk", [None, 7, 1])
def test_repair_equals_recursion(spark, chunk):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in C.repaired(C.damaged(df), chunk_rows=chunk).collect()}
    want = {c: brute_repair(r) for c, r in brute_damage(rows).items()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def test_fix_up_passes_reach_the_vectors_of_one_pass(spark):
    """Rows that must all go carry every vector through: as many passes as chunks."""
    codes = [bytes([C.MUST_GO | 1]) * 5] * 4 + [bytes([1, 2, 1])]
    rows = [(7, i, i + 1 if i < 4 else None, c) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "conv_id bigint, chunk int, next int, codes binary")
    v, passes = C.converged_vectors(df, "bigint")
    whole = C.backward(b"".join(codes), C.LAST)
    for r in v.collect():
        at = sum(len(c) for c in codes[:r.chunk + 1])
        assert len({a - b for a, b in zip(r.right, whole[at])}) == 1
    assert 1 <= passes <= 4


def test_empty_table_and_long_text(spark):
    assert C.repaired(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    big = [(1, t, "user" if t % 2 else "assistant", "word " * 400_000 + ".", "x", 1, 2) for t in range(4)]
    df = spark.createDataFrame(big, SCHEMA)
    got = C.repaired(C.damaged(df), chunk_bytes=1 << 20).collect()
    assert [tuple(r)[1:] for r in got] == [brute_repair(brute_damage(big)[1])]


def test_query_over_the_whole_table(spark):
    import __spark_entry__ as E

    src = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = {c: brute_repair(r) for c, r in brute_damage([tuple(r) for r in src]).items()}
    got = {r.conv_id: tuple(r)[1:] for r in E.queries()["op12_conversation_repair"](spark, SF001).collect()}
    assert got == want
