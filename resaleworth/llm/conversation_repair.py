"""Conversation structure repair: the cheapest edits that make turns alternate, by streaming over sorted turns.

Rows are dealt by conversation once. Faults of a row come from windows on that same dealing. Each row is then sorted in
twice: a light copy (its class only) from the last turn to the first, then the row itself from the first to the last.
One ``mapInPandas`` pass reads both. On the way back it keeps the cost to go of the four states and writes one byte a
row, the best edit in each state; the bytes of a giant conversation go to a temporary file of the task. On the way
forth it reads those bytes from their end and applies the edits. So memory holds a batch, a block of bytes and the audit,
whatever the length; a conversation is one stream and stays in one task. A lost executor repeats its tasks only.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# States: nothing yet, after a system turn, after a user turn, after an assistant turn. A text may end in the first and the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
# The state after a user or assistant turn, whichever may follow; a system turn may only come first.
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# Edits in the order that decides between equally cheap audits, and what they cost.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = b"DIKR"
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
TRUNCATED_COST = 5
# Faults, the first of which counts. Initials of roles.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS, OTHER = "sua", 3
ADJACENT = {(0, 1), (1, 2), (2, 1)}
# Bytes kept in memory for a conversation before they go to a file.
BLOCK = 1 << 20


def kept_state(state: int, initial: int) -> int | None:
    """The state after a turn that stays as it is; None if it may not stand there."""
    if initial == 0:
        return SYSTEM if state == EMPTY else None
    return FOLLOWING[state] if initial != OTHER and FOLLOWING[state] == initial + 1 else None


def end_costs() -> tuple[int, ...]:
    costs = [0 if state in ENDS else None for state in range(4)]
    costs[USER] = COSTS[INSERT]
    costs[SYSTEM] = COSTS[INSERT] + costs[USER]
    return tuple(costs)


def step_back(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs to go before a row from those after it, and the best first edit of each state in two bits each."""
    initial, fault = code >> 2, code & 3
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    options = []
    for state in range(4):
        own = {DELETE: COSTS[DELETE] + after[state]}
        if fault not in (BLANK, DUPLICATE):
            kept = kept_state(state, initial)
            if kept is not None:
                own[KEEP] = COSTS[KEEP] + extra + after[kept]
            own[REROLE] = COSTS[REROLE] + extra + after[FOLLOWING[state]]
        options.append(own)
    costs = [min(own.values()) for own in options]
    for _ in range(3):  # an insert leads to another state before the same row
        costs = [min(cost, COSTS[INSERT] + costs[FOLLOWING[state]]) for state, cost in enumerate(costs)]
    best = 0
    for state, own in enumerate(options):
        own[INSERT] = COSTS[INSERT] + costs[FOLLOWING[state]]
        best |= min(edit for edit, cost in own.items() if cost == costs[state]) << (2 * state)
    return tuple(costs), best


class Choices:
    """One byte a row, written from the last row to the first and read from the first to the last."""

    def __init__(self) -> None:
        self.tail, self.file, self.blocks = bytearray(), None, 0

    def add(self, choice: int) -> None:
        self.tail.append(choice)
        if len(self.tail) == BLOCK:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.tail)
            self.blocks, self.tail = self.blocks + 1, bytearray()

    def __iter__(self) -> Iterator[int]:
        yield from reversed(self.tail)
        for block in range(self.blocks - 1, -1, -1):
            self.file.seek(block * BLOCK)
            yield from reversed(self.file.read(BLOCK))
        if self.file:
            self.file.close()


class Repair:
    """The state of one conversation: fed its light rows from the end, then its rows from the start."""

    seen: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int, int]] = {}

    def __init__(self, conv: str | None):
        self.conv, self.choices, self.costs, self.cost = conv, Choices(), end_costs(), 0
        self.state, self.forth, self.audit, self.place = EMPTY, None, bytearray(), 0
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.high = self.last = None
        self.turns, self.digest = 0, hashlib.sha256()

    def back(self, code: int) -> None:
        # Only differences between the costs matter, so few steps ever have to be worked out.
        key = (self.costs, code)
        if key not in self.seen:
            costs, best = step_back(*key)
            least = min(costs)
            self.seen[key] = tuple(cost - least for cost in costs), best, least
        self.costs, best, least = self.seen[key]
        self.cost += least
        self.choices.add(best)

    def turn(self, edit: int, role: str, text: str) -> tuple:
        self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.conv, self.place - 1, chr(LETTERS[edit]), role, text

    def insert(self) -> tuple:
        self.audit.append(LETTERS[INSERT])
        self.state = FOLLOWING[self.state]
        return self.turn(INSERT, ROLES[self.state], "")

    def row(self, code: int, turn: str | None, role: str, text: str) -> Iterator[tuple]:
        """The repaired turns that this row gives, inserted ones before it included."""
        self.forth = iter(self.choices) if self.forth is None else self.forth
        initial, fault = code >> 2, code & 3
        self.faults[fault] += 1
        self.illegal += self.before is not None and (self.before, initial) not in ADJACENT
        self.before = initial
        if turn is not None:
            number = int(turn)
            self.turns += number != self.last
            self.low = number if self.low is None else self.low
            self.high = self.last = number
        best = next(self.forth)
        while (edit := best >> (2 * self.state) & 3) == INSERT:
            yield self.insert()
        self.audit.append(LETTERS[edit])
        if edit == KEEP:
            self.state = kept_state(self.state, initial)
            yield self.turn(KEEP, role, text)
        elif edit == REROLE:
            self.state = FOLLOWING[self.state]
            yield self.turn(REROLE, ROLES[self.state], text)

    def finish(self) -> Iterator[tuple]:
        while self.state not in ENDS:
            yield self.insert()

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = (gaps, *self.faults[1:], self.illegal, self.cost + self.costs[EMPTY])
        return (self.conv, *counts, self.audit.decode(), self.digest.hexdigest())


SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv string, place long, edit string, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns after damage, nulls of role and text as one space, and ``gone`` for rows that are dropped.

    ``crc32("conv:turn") % 20``, nulls as one space: 0 drops, 1 empties the text, 2 takes its ``[.!?]``, 3 repeats the row, 4 makes it a user's.
    """
    names = {name: F.col(f"`{name}`") for name in (conv, turn, role, text)}
    key = F.concat_ws(":", *[F.coalesce(names[name].cast("string"), F.lit(" ")) for name in (conv, turn)])
    kind = F.crc32(key.cast("binary")) % 20
    whole = F.coalesce(names[text], F.lit(" "))
    damaged = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(whole, "[.!?]", "")).otherwise(whole)
    return turns.select(
        names[conv],
        names[turn],
        F.when(kind == 4, "user").otherwise(F.coalesce(names[role], F.lit(" "))).alias(role),
        damaged.alias(text),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _faults(rows: DataFrame) -> Column:
    """The first fault of a row: no text, role and text seen before, text without an end."""
    same = Window.partitionBy("conv", "gone", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    ended = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")
    return (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~ended, TRUNCATED)
        .otherwise(NONE)
    )


def _streamed(turns: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None, want_turns: bool) -> DataFrame:
    rows = turns.select(
        F.col(f"`{conv}`").cast("string").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    ).repartition("conv")
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))) - 1, F.lit(-1)), F.lit(OTHER))
    initial = F.when(F.col("role") == "", OTHER).otherwise(initial)
    coded = rows.withColumn("fault", _faults(rows)).withColumn("code", initial * 4 + F.col("fault"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "fault")
    placed = coded.withColumn("place", F.row_number().over(order))
    light = F.struct(F.lit(0).alias("pass"), (-F.col("place")).alias("sort"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    full = F.struct(F.lit(1).alias("pass"), F.col("place").alias("sort"), "role", "text")
    both = placed.select(
        "conv",
        F.when(~F.col("gone"), F.col("code")).otherwise(-1).cast("int").alias("code"),
        F.col("turn").cast("string").alias("turn"),
        F.explode(F.when(F.col("gone"), F.array(light)).otherwise(F.array(light, full))).alias("r"),
    ).select("conv", "code", "turn", "r.*")
    ready = both.sortWithinPartitions("conv", "pass", "sort").select("conv", "pass", "code", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        schema = [part.split()[0] for part in (TURNS if want_turns else SUMMARY).split(", ")]
        now: Repair | None = None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[name].tolist() for name in ("conv", "pass", "code", "turn", "role", "text")]
            for key, forth, code, number, who, said in zip(*columns, strict=True):
                if now is None or key != now.conv:
                    if now is not None:
                        out += _closed(now, want_turns)
                    now = Repair(key)
                if code < 0:
                    continue
                if forth:
                    given = list(now.row(code, number, who, said))
                    out += given if want_turns else []
                else:
                    now.back(code)
            yield pd.DataFrame(out, columns=schema)
        if now is not None:
            yield pd.DataFrame(_closed(now, want_turns), columns=schema)

    found = ready.mapInPandas(run, TURNS if want_turns else SUMMARY)
    own = turns.schema[conv].dataType
    return found.select(F.col("conv").cast(own).alias(conv), *[c for c in found.columns if c != "conv"])


def _closed(repair: Repair, want_turns: bool) -> list[tuple]:
    last = list(repair.finish())
    return last if want_turns else [repair.summary()]


def audit_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None
) -> DataFrame:
    """One row per conversation: gaps in its turns, faults, illegal neighbours, the cheapest repair and its hash.

    Rows are taken by turn, nulls first, then by role and text. A row's fault is the first of: blank (no character outside ``[\\x20\\x09-\\x0D]``),
    duplicate (role and text seen earlier), truncated (last such character is none of ``.!?``). Keep costs 0, Rerole to user or
    assistant 1, Delete 2, Insert of an empty user or assistant turn 5; a truncated turn that stays costs 5 more; blank and duplicate ones
    must go. The turns that are left begin with s, u, a as in ``(s?(ua)+)?``. Of equally cheap edits the audit that is least in ASCII counts.

    ``gone`` names a boolean column of rows that only say that their conversation exists; without other rows it gets
    zeros, an empty audit and the hash of the empty string. Null role and text: one space. A null conversation is one of its own, null turns
    count for no gap. Rows that repeat are duplicates. An empty table gives no row. Other columns are left out.
    """
    return _streamed(turns, conv, turn, role, text, gone, want_turns=False)


def repair_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None
) -> DataFrame:
    """The turns after the cheapest repair: conversation, ``place`` from 0, ``edit`` (K, R or I), ``role`` and ``text``; rules as in ``audit_conversations``."""
    return _streamed(turns, conv, turn, role, text, gone, want_turns=True)
