"""Conversation repair against trying all edits, and its defined cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from callsheet.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(symbols):
    """(cost, audit) by trying every edit."""
    n = len(symbols)

    @lru_cache(None)
    def go(i, state, inserted):
        ways = [(0, "")] if i == n and state in (repair.START, repair.A) else []
        if inserted < 3:
            c, rest = go(i, repair.FOLLOW[state], inserted + 1)
            ways.append((c + 5, "I" + rest))
        if i < n:
            for e, cost, to in repair.edits(symbols[i], state):
                c, rest = go(i + 1, to, 0)
                ways.append((c + cost, e + rest))
        return min(ways, default=(10**9, ""))
    return go(0, repair.START, 0)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_tables_find_the_cheapest_and_least_audit(block):
    tables, rng = repair.Tables(block), random.Random(block)
    assert len(tables.vectors) < 40
    for _ in range(600):
        s = bytes(rng.choice(range(1, repair.SYMBOLS)) for _ in range(rng.randint(0, 11)))
        cost, audit = cheapest(s)
        assert tables.audit(s) == (audit, cost)


def test_long_conversations_take_one_lookup_a_block():
    audit, cost = repair.Tables().audit(bytes([4, 6] * 50_000))
    assert (audit, cost) == ("K" * 100_000, 0)


def plain(rows):
    out = {}
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        convs.setdefault(c, [])
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        convs[c] += [(t, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    for c, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, symbols, faults = set(), [], [0, 0, 0, 0]
        for t, role, text in got:
            solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            symbols.append(1 if fault in (1, 2) else 2 + 2 * ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3) + (fault == 3))
        turns = {t for t, _, _ in got if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        cost, audit = cheapest(tuple(symbols))
        lines, i = [], 0
        kept = sum(e != "D" for e in audit)
        roles = (["s"] if kept % 2 else []) + ["user", "assistant"] * (kept // 2)
        for e in audit:
            if e != "D":
                want = roles[len(lines)]
                lines.append(f"{got[i][1] if e == 'K' else want}:{got[i][2] if e != 'I' else ''}")
            i += e != "I"
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults[1:], illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in repair.summary(repair.damaged(df)).collect()}


def rows(n=150):
    rng = random.Random(9)
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "What? ", "a.b\n", "", " \t", None, f"line {rng.randint(0, 9)}!\nnext", "é。", "Fine.\x0b"])
            out.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), role, text))
    return out + [(None, 0, "user", "Hi."), (None, None, "assistant", "Hi."), (-7, 3, "user", "x" * 100_000 + ".")] + out[:30]


def test_equals_trying_all_edits(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6).withColumns({c: F.lit("clash") for c in ("symbol", "audit", "gone", "cost", "at", "kind", "digest")})
    assert repaired(df) == plain(rows())


def test_conversations_that_lose_all_rows_and_no_rows(spark):
    gone = [c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(c, 0, "user", "Hi.") for c in gone], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert repaired(df) == {c: (0, 0, 0, 0, 0, 0, "", empty) for c in gone}
    assert repaired(df.where("conv_id < 0")) == {}


def test_repaired_rows_are_well_formed(spark):
    df = spark.createDataFrame(rows(60), SCHEMA)
    convs = {}
    for r in repair.repaired(repair.damaged(df)).orderBy("conv_id", "at").collect():
        convs.setdefault(r.conv_id, []).append(r.role[:1])
    assert convs and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in convs.values())


def test_one_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = [(1, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(300)]
        got = repaired(spark.createDataFrame(many, SCHEMA))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got[1][6]) >= 280 and got[1][0] == sum(zlib.crc32(f"1:{t}".encode()) % 20 == 0 for t in range(1, 299))
