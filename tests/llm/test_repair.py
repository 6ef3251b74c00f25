import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from venuemill.llm import repair
from venuemill.llm.queries_llm import op13_conversation_repair

SCHEMA = "turn long, conv_id long, text string, role string, copies int, at long"
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired) by trying every string of edits; rows are (role, text, fault)."""
    best = None
    most = 3 * len(rows)

    def go(i, made, cost, audit):
        nonlocal best
        if cost > most or (best and cost > best[0]):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in made)):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, made)
        if audit[-3:] != "III":
            for name in ("user", "assistant"):
                go(i, [*made, (name, "")], cost + 2, audit + "I")
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, made, cost + 3, audit + "D")
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                go(i + 1, [*made, (role, text)], cost + extra, audit + "K")
                for name in ("user", "assistant"):
                    go(i + 1, [*made, (name, text)], cost + 2 + extra, audit + "R")

    go(0, [], 0, "")
    return best


def brute(rows, damage=False):
    convs = defaultdict(list)
    for turn, conv, text, role in rows:
        text, role = text if text is not None else " ", role if role is not None else " "
        convs[conv]
        n = 1
        if damage:
            case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if case == 0:
                continue
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            n, role = 1 + (case == 3), "user" if case == 4 else role
        convs[conv] += [(turn, role, text)] * n
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            plain = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None
            seen.add((role, text))
            judged.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, made = cheapest(judged)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def awkward():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "cut off", "", " \n", "What?", "Yes.", None, "Ünï ✓.", "x." * 3000]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    rows = []
    for conv in [*range(150), None]:
        turns = [rng.choice([None, rng.randint(0, 6)]) for _ in range(rng.randint(0, 5))] if rng.random() < 0.5 else list(range(rng.randint(1, 5)))
        for t in turns:
            rows.append((t, conv, rng.choice(texts), rng.choice(roles)))
    rows += [rows[0], rows[1], (3, 7, "Yes.", "user")]
    return rows


def query(spark, rows, tmp_path):
    path = tmp_path / "conversations.parquet"
    spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3).write.parquet(str(path))
    return op13_conversation_repair(spark, str(tmp_path)).collect()


def test_query_equals_trying_all(spark, tmp_path):
    rows = awkward()
    got = {r["conv_id"]: tuple(r)[1:] for r in query(spark, rows, tmp_path)}
    assert got == brute(rows, damage=True)


def test_operator_equals_trying_all(spark):
    rows = awkward()
    made = repair.repair_conversations(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3))
    want = brute(rows)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in made.summary.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    digests = {r["conv_id"]: r["sha256"] for r in repair.digests(made.messages).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert {k: digests.get(k, empty) for k in want} == {k: v[-1] for k, v in want.items()}


def test_no_rows(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


@pytest.mark.parametrize("n", [1, 5, 300, 5000])
def test_long_runs(n):
    """Runs beyond a piece: the same costs as row by row, and steps that cost what the plan says."""
    rng = random.Random(n)
    symbols = bytes(itertools.chain.from_iterable([rng.randrange(12)] * rng.choice([1, 2, n]) for _ in range(12)))
    costs = repair.END
    for s in reversed(symbols):
        costs = repair._apply(repair.power(s, 0), costs)
    plan = repair.Plan(symbols)
    steps = list(plan.steps())
    assert plan.cost == costs[repair.START] and len(steps) == len(symbols) + 1
    price = {"D": 3, "I": 2, "R": 2, "K": 0}
    cost = sum(price[c] for s in steps for c in s if c.isupper())
    cost += sum(sym % 3 == repair.SHORT and "D" not in step for sym, step in zip(symbols, steps))
    assert cost == plan.cost


def test_many_runs(monkeypatch):
    rng = random.Random(2)
    symbols = bytes(rng.randrange(12) for _ in range(3000))
    whole = list(repair.Plan(symbols).steps())
    monkeypatch.setattr(repair, "RUNS", 7)
    monkeypatch.setattr(repair, "PIECE", 2)
    assert list(repair.Plan(symbols).steps()) == whole
