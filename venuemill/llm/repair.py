"""Repair of the role structure of conversations, by a dynamic program over runs.

A row is a symbol: the initial of its role and whether it is fine, truncated or must go (blank, repeated).  Equal
symbols in a row are one run.  Editing one row is a min-plus matrix over the role placed last; the costs before a run
come from those after it through cached binary powers of its matrix, and the edits are then unrolled from left to right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuemill.llm import blocks
from venuemill.llm.rolling import first_of_runs
from venuemill.llm.store import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: The role placed last: none, system, user, assistant.  A conversation may end after none and after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_NAMES = {"u": "user", "a": "assistant"}
_LETTER = {USER: "u", ASSISTANT: "a"}
_INITIALS = {"s": 0, "u": 1, "a": 2}
FINE, SHORT, GOES = range(3)
NEVER = 1 << 60
#: Rows unrolled and runs followed at a time, and steps in a row of the plan.
PIECE, RUNS, SLICE = 256, 4096, 4096
_WHITE = " \t\n\x0b\f\r"

Vector = tuple[int, int, int, int]


def symbol(initial: str, fault: int) -> int:
    return 3 * _INITIALS.get(initial, 3) + fault


def _placed(sym: int, last: int) -> int | None:
    """The role placed last after a row of this symbol is kept, if it may be."""
    role, fault = divmod(sym, 3)
    if fault == GOES:
        return None
    if role == 0:
        return SYSTEM if last == START else None
    if role == 1:
        return USER if last != USER else None
    return ASSISTANT if role == 2 and last == USER else None


def _times(a: tuple[Vector, ...], b: tuple[Vector, ...]) -> tuple[Vector, ...]:
    return tuple(tuple(min(min(x + b[k][q] for k, x in enumerate(row)), NEVER) for q in range(4)) for row in a)


def _apply(a: tuple[Vector, ...], after: Vector) -> Vector:
    return tuple(min(min(x + y for x, y in zip(row, after)), NEVER) for row in a)


def _inserts() -> tuple[Vector, ...]:
    """Least cost of inserted rows from one role placed last to another."""
    one = tuple(tuple(0 if p == q else INSERT if NEXT[p] == q else NEVER for q in range(4)) for p in range(4))
    return _times(_times(one, one), one)


_INSERTS = _inserts()
END: Vector = _apply(_INSERTS, (0, NEVER, NEVER, 0))


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> tuple[Vector, ...]:
    """Least costs of editing 2**k rows of one symbol, inserts before each included (12 symbols, at most 64 powers)."""
    if k:
        half = power(sym, k - 1)
        return _times(half, half)
    extra = TRUNCATED * (sym % 3 == SHORT)
    edit = [[NEVER] * 4 for _ in range(4)]
    for last in range(4):
        edit[last][last] = DELETE
        if sym % 3 != GOES:
            edit[last][NEXT[last]] = min(edit[last][NEXT[last]], REROLE + extra)
        placed = _placed(sym, last)
        if placed is not None:
            edit[last][placed] = min(edit[last][placed], KEEP + extra)
    return _times(_INSERTS, tuple(map(tuple, edit)))


def before(sym: int, n: int, after: Vector) -> Vector:
    """Costs before a run of ``n`` rows, from those after it."""
    k = 0
    while n:
        if n & 1:
            after = _apply(power(sym, k), after)
        n >>= 1
        k += 1
    return after


def _step(sym: int, last: int, now: Vector, after: Vector) -> tuple[str, int]:
    """The cheapest edits of one row, inserts before it included, ASCII-least among equals; and the role then placed last."""
    out, extra = "", TRUNCATED * (sym % 3 == SHORT)
    while True:
        least = now[last]
        if DELETE + after[last] == least:
            return out + "D", last
        following = NEXT[last]
        if INSERT + now[following] == least:
            out += "I" + _LETTER[following]
            last = following
            continue
        placed = _placed(sym, last)
        if placed is not None and KEEP + extra + after[placed] == least:
            return out + "K", placed
        return f"{out}R{_LETTER[following]}", following


def _unrolled(sym: int, n: int, last: int, after: Vector):
    for done in range(0, n, PIECE):
        m = min(PIECE, n - done)
        costs = [before(sym, n - done - m, after)]  # with 0, 1, ... rows of the piece still to come
        for _ in range(m):
            costs.append(_apply(power(sym, 0), costs[-1]))
        for left in range(m, 0, -1):
            step, last = _step(sym, last, costs[left], costs[left - 1])
            yield step
    return last


class Plan:
    """The cheapest repair of a sequence of symbols: its cost, and its steps in order.

    A step is what happens up to and with one row: ``I`` and ``R`` are followed by the initial of the role they
    give.  One more step at the end holds the inserts after the last row.  Beside the symbols the
    plan keeps one vector of costs for each ``RUNS`` runs.
    """

    def __init__(self, symbols: bytes):
        data = np.frombuffer(symbols, np.uint8)
        first = np.flatnonzero(first_of_runs(data))
        self.symbols, self.sizes = data[first], np.diff(np.append(first, len(data)))
        now, self.after = END, [END]
        for at in range(len(first) - 1, -1, -1):
            now = before(int(self.symbols[at]), int(self.sizes[at]), now)
            if at % RUNS == 0:
                self.after.append(now)
        self.after.reverse()  # costs before each block of runs, and at the end
        self.cost = self.after[0][START]

    def steps(self) -> Iterator[str]:
        last = START
        for block, at in enumerate(range(0, len(self.symbols), RUNS)):
            runs = list(zip(self.symbols[at : at + RUNS].tolist(), self.sizes[at : at + RUNS].tolist()))
            after = [self.after[block + 1]]
            for sym, n in reversed(runs[1:]):
                after.append(before(sym, n, after[-1]))
            for (sym, n), costs in zip(runs, reversed(after)):
                last = yield from _unrolled(sym, n, last, costs)
        tail = ""
        while last not in (START, ASSISTANT):
            last = NEXT[last]
            tail += "I" + _LETTER[last]
        yield tail


@lru_cache(maxsize=50_000)
def _short_plan(symbols: bytes) -> tuple[int, tuple[str, ...]]:
    plan = Plan(symbols)
    return plan.cost, tuple(plan.steps())


def audit_of(steps: str) -> str:
    return steps.translate({ord("u"): None, ord("a"): None})


class Repairs(NamedTuple):
    """``summary``: one row per conversation; ``messages``: the repaired rows in the order of (at, k) within a conversation."""

    summary: DataFrame
    messages: DataFrame


def _faults(rows: DataFrame) -> DataFrame:
    """The distinct rows of each conversation with their number of copies, digest, fault of the first copy and symbol parts."""
    end = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copies", fault.alias("own_fault"))


STREAM = "turn long, role string, digest binary, at long, first_step long, steps array<string>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class _Conversation:
    """What is gathered of one conversation while its rows pass in order: one byte a row."""

    def __init__(self, name):
        self.name, self.symbols, self.last = name, bytearray(), None
        self.turns, self.low, self.high = 0, None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def add(self, turn: int | None, role: str, copies: int, fault: str | None) -> int:
        """The place of the row's first copy."""
        at, initial = len(self.symbols), role[:1]
        again = "blank" if fault == "blank" else "duplicate"
        for f, n in ((fault, 1), (again, copies - 1)):
            if f and n:
                self.counts[f] += n
        self.symbols.append(symbol(initial, FINE if fault is None else SHORT if fault == "truncated" else GOES))
        if copies > 1:
            self.symbols.extend(bytes([symbol(initial, GOES)]) * (copies - 1))
            self.counts["illegal"] += copies - 1
        if self.last is not None and (self.last, initial) not in _LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        return at

    def rows(self) -> Iterator[dict]:
        symbols = bytes(self.symbols)
        if len(symbols) <= 64:
            cost, steps = _short_plan(symbols)
        else:
            plan = Plan(symbols)
            cost, steps = plan.cost, plan.steps()
        audit, held, first = [], [], 0
        for step in steps:
            held.append(step)
            if len(held) == SLICE:
                audit.append(audit_of("".join(held)))
                yield {"conv_id": self.name, "first_step": first, "steps": held}
                first, held = first + SLICE, []
        audit.append(audit_of("".join(held)))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        yield {"conv_id": self.name, "first_step": first, "steps": held, "gaps": gaps, "cost": cost, "audit": "".join(audit), **self.counts}


def repair_conversations(rows: DataFrame) -> Repairs:
    """The cheapest repair of each conversation to an optional system row and then pairs of user and assistant.

    ``rows`` has (conv_id, turn, role, text).  They are taken by turn (nulls first), then role, then SHA-256 of the text.
    A null role or text is one space; a row whose role begins with none of s, u and a cannot be kept as it is; rows without a
    conv_id are one conversation.  The first fault
    counts: blank (no character besides white space), duplicate (role and text seen earlier; repeated rows are), truncated
    (the last such character is none of ``.!?``).  Costs: the constants of this module.

    ``summary``: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).  ``messages``: (conv_id, at, k,
    edit, role, text), without the deleted rows.

    Copies are folded first.  A conversation's rows pass one task in order, which keeps one byte for each, as its audit needs one too;
    texts stay where they are and meet their edits by a join.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    folded = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text")).groupBy(
        "conv_id", "turn", "role", "text"
    ).agg(F.count(F.lit(1)).alias("copies"))
    folded = stored(folded, "turns")
    own = _faults(folded)
    earliest = own.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))).alias("earliest")
    ).withColumnsRenamed({"conv_id": "c", "role": "r", "digest": "d"})
    judged = own.join(earliest, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    again = ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    fault = F.when(F.col("own_fault") == "blank", "blank").when(again, "duplicate").otherwise(F.col("own_fault"))
    ordered = judged.select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault")).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "digest"
    )

    schema = f"conv_id {kind}, {STREAM}"
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        types = None

        def packed(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in zip(names, types)], names)

        for batch in batches:
            if types is None:
                types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.string()), *[pa.int64()] * 6, pa.string()]
            out = []
            for conv, turn, role, digest, copies, fault in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now is None or conv != now.name:
                    if now is not None:
                        for r in now.rows():
                            out.append(r)
                            if r["steps"] and len(r["steps"]) == SLICE:
                                yield packed(out)
                                out = []
                    now = _Conversation(conv)
                out.append({"conv_id": conv, "turn": turn, "role": role, "digest": digest, "at": now.add(turn, role, copies, fault)})
            yield packed(out)
        if now is not None:
            for r in now.rows():
                yield packed([r])

    passed = stored(ordered.mapInArrow(blocks.frugal(run), schema), "repairs")
    summary = passed.filter("audit IS NOT NULL").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    steps = passed.filter("steps IS NOT NULL").select(F.col("conv_id").alias("c"), "first_step", F.posexplode("steps").alias("i", "step")).select(
        "c", (F.col("first_step") + F.col("i")).alias("place"), F.posexplode(F.regexp_extract_all("step", F.lit("([IR][ua]|K)"), 1)).alias("k", "edit")
    )
    places = passed.filter("at IS NOT NULL").select("conv_id", "turn", "role", "digest", "at")
    letter, given = F.substring("edit", 1, 1), F.substring("edit", 2, 1)
    named = F.when(given == "u", ROLE_NAMES["u"]).when(given == "a", ROLE_NAMES["a"])
    inserted = steps.filter(letter == "I").select(
        F.col("c").alias("conv_id"), F.col("place").alias("at"), "k", F.lit("I").alias("edit"), named.alias("role"), F.lit("").alias("text")
    )
    left = steps.filter(letter != "I").join(places, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("place") == F.col("at"))).select(
        F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), "at", "k", letter.alias("edit"), named.alias("new_role")
    )
    whole = folded.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    same = whole["conv_id"].eqNullSafe(F.col("c")) & whole["turn"].eqNullSafe(F.col("t")) & (whole["role"] == F.col("r")) & (whole["digest"] == F.col("d"))
    kept = left.join(whole, same).select("conv_id", "at", "k", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    return Repairs(summary, kept.unionByName(inserted))


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, sha256) over the lines ``role:text`` of each conversation, in order; its rows pass one task as a stream."""
    kind = messages.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = digest = None
        for batch in batches:
            names, out = [], []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if digest is None or conv != name:
                    if digest is not None:
                        names.append(name)
                        out.append(digest.hexdigest())
                    name, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.array(out, pa.string())], ["conv_id", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], batch.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "sha256"])

    dealt = messages.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k")
    return dealt.select("conv_id", "role", "text").mapInArrow(blocks.frugal(run), f"conv_id {kind}, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case: Column = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(one("role"))
    copies = F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    cased = rows.select("conv_id", "turn", "role", "text", case.alias("case")).filter("case != 0")
    return cased.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
