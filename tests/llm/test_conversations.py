"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from resaleworth.llm import conversation_repair as repair

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in convs.values():
        kept.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]))
    return convs


def follow(state, letter):
    return {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(letter, {}).get(state)


def cheapest(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        known = (role, text) in seen
        faults.append("blank" if not text.strip(WHITE) else "duplicate" if known else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))
    letters = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    turns = [turn for turn, *_ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            counts = (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"))
            return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), list(out)
        for name in ("user", "assistant"):
            if (after := follow(state, name[0])) is not None:
                heapq.heappush(heap, (cost + 5, audit + "I", at, after, (*out, f"{name}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
            if faults[at] in ("", "truncated"):
                more = 5 if faults[at] else 0
                if (after := follow(state, role[:1])) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, after, (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if (after := follow(state, name[0])) is not None:
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, after, (*out, f"{name}:{text}")))


def conversations(seed=5, n=200):
    rng, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "a", "S"]
    texts = ["Hi.", "ok!", "what?\n", "no", "", " \n", None, "é. ", "z ."]
    for conv in [*range(n), None]:
        turn = 0
        for _ in range(rng.randint(1, 14)):
            turn += rng.choice([0, 1, 1, 1, 2, 3])
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice([*texts, f"t{rng.random()}.", f"t{rng.random()}."])))
    return rows


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_cheapest_edits(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = conversations()
    damage = repair.damage_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    expected = {conv: cheapest(kept) for conv, kept in damaged(rows).items()}
    got = {r[0]: tuple(r[1:]) for r in repair.audit_conversations(damage, gone="gone").collect()}
    assert got == {conv: row for conv, (row, _) in expected.items()}
    turns = {}
    for r in repair.repair_conversations(damage, gone="gone").orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(turns.get(conv, []) == out for conv, (_, out) in expected.items())


def test_giant_conversation_over_many_batches(spark):
    """More rows than a batch and a block of bytes hold; repaired in order."""
    rows = [(1, i, ("user", "assistant")[i % 2] if i % 7 else "assistant", f"said {i}" + (". " if i % 11 else "")) for i in range(20_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    audit = repair.audit_conversations(spark.createDataFrame(rows + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")], SCHEMA))
    got = {r.conv_id: r for r in audit.collect()}
    state, costs = repair.EMPTY, repair.end_costs()
    letters = {"system": 0, "user": 1, "assistant": 2}
    total = 0
    for _, _, role, text in reversed(rows):
        costs, _ = repair.step_back(costs, letters[role] * 4 + (repair.NONE if text.rstrip(WHITE)[-1] == "." else repair.TRUNCATED))
        least = min(costs)
        costs, total = tuple(c - least for c in costs), total + least
    assert got[1].cost == total + costs[state] and len(got[1].audit.replace("I", "")) == 20_000
    assert got[2].audit == "KK" and got[2].cost == 0


def test_odd_tables(spark):
    schema = "conv string, n int, who string, text string, `role` string, `pass` string, place string"
    frame = spark.createDataFrame([("x", None, "user", "a.", "r", "p", "q"), ("x", 3, "assistant", "b.", "r", "p", "q"), (None, 1, None, None, None, None, None)], schema)
    got = {r.conv: r for r in repair.audit_conversations(frame, "conv", "n", "who", "text").collect()}
    assert (got["x"].audit, got["x"].gaps) == ("KK", 0) and (got[None].audit, got[None].blank) == ("D", 1)
    assert repair.audit_conversations(frame.limit(0), "conv", "n", "who", "text").count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "a.", True)], f"{SCHEMA}, gone boolean")
    row = repair.audit_conversations(gone, gone="gone").first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_conversations(gone, gone="gone").count() == 0


def test_choices_come_back_from_the_end(monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 7)
    for n in (0, 1, 6, 7, 8, 14, 50):
        choices = repair.Choices()
        for i in range(n):
            choices.add(i % 251)
        assert (choices.file is None) == (n < 7)
        assert list(choices) == [i % 251 for i in range(n)][::-1]
