r"""Cheapest repair of damaged conversations by Four-Russians block tables.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. Edits:
Keep (0), Rerole to user or assistant (1), Delete (2; the only edit of blank
and repeated rows), Insert an empty user or assistant turn (5); a truncated
row that stays costs 5 more. The audit is the cheapest edits' initials in
order, of equal costs the ASCII-least.

A row is one of nine symbols (its initial, truncated or not; or to be
deleted). Costs to go are kept for four states (nothing yet, after s, after u,
after a) and differ by a bounded amount, so that only a few vectors of
differences exist. ``Tables`` finds them all and, for every one of them and
every block of ``BLOCK`` symbols, what the block costs and which vector stands
before it. A conversation is read from its end, one lookup a block; then each
block is expanded backward from the vector behind it, and its edits are chosen
forward, the ASCII-least of those that keep the cost. Expanded blocks are
remembered.

On Spark, first faults come from row facts and one window over digests; the
audit stage sorts those facts (some 50 bytes a row, no texts) by conversation
and streams them, holding one byte a row of the conversation at hand; the last
stage sorts the texts behind their audit and streams them. A conversation's
rows are read by one task, in order, as its digest needs, and never gathered.

Defined cases: a null role or text counts as one space, as do null ids and
turns in what chooses the damage; null turns come first, null conversation ids
are one conversation; rows of one turn go by role and then by the MD5 of the
text, so repeated rows are neighbours (all but the first are duplicates); a
role is known by its first character alone, and an empty role is none of
s, u, a; a conversation without rows has an empty audit; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callsheet.llm import frames

# What the edits cost, the damage's modulus
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
DAMAGE = 20
BLOCK = 4
#: symbols: 0 nothing (fills the last block), 1 to be deleted, else 2 + 2 * initial + truncated
INITIALS = "sua"
SYMBOLS = 2 + 2 * (len(INITIALS) + 1)
GONE, START, S, U, A = 255, 0, 1, 2, 3
#: state after a user or assistant turn, where the pattern lets one follow
FOLLOW = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _closed(w: list[int]) -> tuple[int, ...]:
    """Costs to go once insertions before the next row are allowed."""
    u, a = min(w[U], INSERT + w[A]), min(w[A], INSERT + w[U])
    return min(w[START], INSERT + u), min(w[S], INSERT + u), u, a


def _kept(symbol: int, state: int) -> int | None:
    """State after a kept row, if it may be kept there."""
    initial = (symbol - 2) // 2
    if initial == 0:
        return S if state == START else None
    return FOLLOW[state] if initial < 3 and FOLLOW[state] == (U if initial == 1 else A) else None


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of what may be done to a row, in ASCII order."""
    yield "D", DELETE, state
    if symbol > 1:
        more = TRUNCATED * (symbol % 2)
        if (to := _kept(symbol, state)) is not None:
            yield "K", KEEP + more, to
        yield "R", REROLE + more, FOLLOW[state]


class Tables:
    """Block transitions between normalised cost vectors."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.end = _closed([0, 4 * INSERT, 4 * INSERT, 0])
        self.vectors, places, steps = [self.end], {self.end: 0}, []
        for v in self.vectors:  # grows until no symbol leads to a new vector
            row = []
            for x in range(SYMBOLS):
                w = v if not x else _closed([min(c + v[to] for _, c, to in edits(x, s)) for s in range(4)])
                low = min(w)
                w = tuple(c - low for c in w)
                if w not in places:
                    places[w] = len(self.vectors)
                    self.vectors.append(w)
                row.append((places[w], low))
            steps.append(row)
        self.steps = steps
        to, cost = (np.array([[x[i] for x in row] for row in steps]) for i in (0, 1))
        before, total = np.arange(len(steps))[:, None], np.zeros((len(steps), 1), int)
        for _ in range(block):  # one more symbol at the front of the block
            before, total = (np.concatenate([f(x) for x in range(SYMBOLS)], axis=1) for f in (
                lambda x: to[before, x], lambda x: total + cost[before, x]))
        self.before, self.cost = before.tolist(), total.tolist()
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self._expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def audit(self, symbols: bytes) -> tuple[str, int]:
        """Initials of the cheapest edits, and their cost."""
        x = np.frombuffer(symbols, np.uint8).astype(np.int64)
        x = np.concatenate((x, np.zeros(-len(x) % self.block, np.int64)))
        codes = (x.reshape(-1, self.block) @ self.weights).tolist()
        v, total, behind = 0, 0, []
        for code in reversed(codes):
            behind.append(v)
            total += self.cost[v][code]
            v = self.before[v][code]
        total += self.vectors[v][START]
        state, out = START, []
        for code, v in zip(codes, reversed(behind)):
            piece, state = self.expanded(v, code, state)
            out.append(piece)
        while self.end[state]:
            out.append("I")
            state = FOLLOW[state]
        return "".join(out), total

    def expanded(self, v: int, code: int, state: int) -> tuple[str, int]:
        """(edits, state behind) of a block with vector ``v`` behind it."""
        key = v, code, state
        if key not in self._expanded:
            self._expanded[key] = self._expand(v, code, state)
        return self._expanded[key]

    def _expand(self, v: int, code: int, state: int) -> tuple[str, int]:
        symbols = [code // int(w) % SYMBOLS for w in self.weights]
        inner = [self.vectors[v]]
        low = 0
        for x in reversed(symbols):
            v, more = self.steps[v][x]
            low += more
            inner.append(tuple(c + low for c in self.vectors[v]))
        inner.reverse()
        out = []
        for i, x in enumerate(symbols):
            while x:
                here, after = inner[i], inner[i + 1]
                ways = [(e, to, True) for e, c, to in edits(x, state) if c + after[to] == here[state]]
                if INSERT + here[FOLLOW[state]] == here[state]:
                    ways.append(("I", FOLLOW[state], False))
                e, state, done = min(ways)
                out.append(e)
                if done:
                    break
        return "".join(out), state


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows as the fixed damage leaves
    them; what it drops stays, marked as gone."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(rows[conv].cast("string"), blank), F.lit(":"), F.coalesce(rows[turn].cast("string"), blank))
    got = rows.select(rows[conv].alias("conv_id"), rows[turn].cast("long").alias("turn"), F.coalesce(rows[role].cast("string"), blank).alias("role"),
                      F.coalesce(rows[text].cast("string"), blank).alias("text"), (F.crc32(key.cast("binary")) % DAMAGE).alias("_how"))
    got = got.withColumn("text", F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    got = got.withColumn("role", F.when(F.col("_how") == 4, "user").otherwise(F.col("role"))).withColumn("gone", F.col("_how") == 0)
    twice = F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return got.select("conv_id", "turn", "role", "text", "gone", twice.alias("_copy")).drop("_copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, gone, fault, symbol) of damaged rows:
    fault 1 blank, 2 duplicate, 3 truncated, 0 none."""
    facts = rows.select("conv_id", "turn", "role", _digest(), "gone", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("_blank"),
                        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("_cut"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "gone").orderBy("turn"))
    fault = F.when(F.col("_blank"), 1).when(F.col("_nth") > 1, 2).when(F.col("_cut"), 3).otherwise(0)
    initial = F.lit(len(INITIALS))
    for k, c in enumerate(INITIALS):
        initial = F.when(F.col("role").startswith(c), k).otherwise(initial)
    symbol = F.when(F.col("gone"), GONE).when(F.col("fault").isin(1, 2), 1).otherwise(2 + 2 * initial + (F.col("fault") == 3).cast("int"))
    return facts.withColumn("_nth", nth).select("conv_id", "turn", "role", "digest", "gone", fault.alias("fault"), initial.alias("initial")).withColumn("symbol", symbol)


class _Counts:
    """What is known of the conversation at hand."""

    def __init__(self, conv):
        self.conv, self.symbols, self.faults = conv, bytearray(), [0, 0, 0, 0]
        self.first = self.turn = self.initial = None
        self.turns = self.illegal = 0

    def add(self, turn, fault: int, initial: int, symbol: int) -> None:
        if symbol == GONE:
            return
        self.symbols.append(symbol)
        self.faults[fault] += 1
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and (self.initial, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.initial = initial

    def row(self, tables: Tables) -> tuple:
        audit, cost = tables.audit(bytes(self.symbols))
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return self.conv, gaps, *self.faults[1:], self.illegal, cost, audit


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def _audit(block: int):
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, now = Tables(block), None
        for batch in batches:
            done = []
            kind = batch.schema.field("conv_id").type
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "initial", "symbol"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row(tables))
                    now = _Counts(conv)
                now.add(*row)
            yield _batch(done, ["conv_id", *COUNTS, "audit"], [kind, *[pa.int64()] * len(COUNTS), pa.string()])
        if now is not None:
            yield _batch([now.row(tables)], ["conv_id", *COUNTS, "audit"], [kind, *[pa.int64()] * len(COUNTS), pa.string()])
    return audit


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of
    every conversation of damaged rows, with those that lost all rows."""
    parts = frames.partitions(rows.sparkSession)
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])
    by = faults(rows).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return by.mapInArrow(_audit(block), schema)


_ADDED = ["at", "edit", "role", "text"]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every conversation's audit (place 0) and its repaired rows in order."""
    conv, audit, done, state, at = None, "", 0, START, 0
    names, size = ["conv_id", *_ADDED, *COUNTS, "audit"], 0
    none = (None,) * (len(COUNTS) + 1)
    out: list[tuple] = []

    def put(edit: str, role: str, text: str) -> None:
        nonlocal at, size
        at += 1
        size += len(text) + 50
        out.append((conv, at, edit, role, text, *none))

    def inserted() -> None:
        nonlocal state, done
        while done < len(audit) and audit[done] == "I":
            state, done = FOLLOW[state], done + 1
            put("I", ROLE[state], "")

    for batch in batches:
        types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * len(COUNTS), pa.string()]
        for c, kind, role, text, *head in zip(*(batch.column(x).to_pylist() for x in ["conv_id", "kind", "role", "text", *COUNTS, "audit"])):
            if size > 8 << 20:
                yield _batch(out, names, types)
                out.clear()
                size = 0
            if kind == 0:
                inserted()  # behind the last row of the conversation before
                conv, audit, done, state, at = c, head[-1], 0, START, 0
                out.append((c, 0, None, None, None, *head))
                continue
            inserted()
            edit, done = audit[done], done + 1
            if edit == "K":
                state = S if role[:1] == "s" else FOLLOW[state]
                put("K", role, text)
            elif edit == "R":
                state = FOLLOW[state]
                put("R", ROLE[state], text)
    inserted()
    if out:
        yield _batch(out, names, types)


def edited(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, edit, role, text, counts, audit): per conversation its
    audit at place 0, then the repaired rows, sorted within partitions."""
    parts = frames.partitions(rows.sparkSession)
    none = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    heads = audits(rows, block).select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                                       F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), *COUNTS, "audit")
    texts = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", _digest(), *none, F.lit(None).cast("string").alias("audit"))
    both = heads.unionByName(texts).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("at", T.LongType()), *[T.StructField(c, T.StringType()) for c in _ADDED[1:]],
                           *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])
    return both.mapInArrow(_apply, schema)


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, edit, role, text): the rows of the repaired conversations."""
    return edited(rows, block).where("at > 0").select("conv_id", *_ADDED)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    head, digest = None, hashlib.sha256()
    for batch in batches:
        types = [batch.schema.field("conv_id").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        done = []
        for at, role, text, *row in zip(*(batch.column(c).to_pylist() for c in ["at", "role", "text", "conv_id", *COUNTS, "audit"])):
            if at == 0:
                if head is not None:
                    done.append((*head, digest.hexdigest()))
                head, digest = row, hashlib.sha256()
                continue
            digest.update(f"{chr(10) if at > 1 else ''}{role}:{text}".encode())
        yield _batch(done, names, types)
    if head is not None:
        yield _batch([(*head, digest.hexdigest())], names, types)


def summary(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation its counts, audit and the SHA-256 of its repaired rows
    (``role:text``, joined by newlines)."""
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return edited(rows, block).mapInArrow(_summed, schema)
