"""Operator 12: conversations repaired to alternate, by cheapest edits found in one pass.

Rows are dealt out by conversation and sorted by turn inside the partitions, so a task meets each
conversation as a stream. A row may be kept, given the role the place asks for, or deleted, and
empty turns may be inserted, so that the roles read ``(s?(ua)+)?``. For each of the four states
of that pattern the stream carries the cost of the best edits so far and their order by letters;
one byte a state remembers from where and by which edit it was reached. All of that is carried
from one Arrow batch to the next. Rows whose edit does not depend on what follows any more (all
states came by the same way) are given out; of a conversation that keeps its choice open, rows
and bytes go to a temporary file of the task, block by block, and are read back from its end.
What a task holds therefore does not grow with a conversation. A conversation is the unit of
work: a single one is read by one task, at the pace of its hash.

Ties go to the edits whose letters (D, I, K, R in order) are least. Edits are compared as they
are made: two different ways into one state, of equal cost, never begin alike.

Whether role and text were seen before in a conversation comes from a window over conversation,
role and text, which needs no further shuffle and spills like any sort.

Defined results: a null role or text counts as one space, a null turn sorts first and is in no
gap, null conversation ids are one conversation. Rows of one turn are ordered by role and text.
A role's initial is its first character; one without initial fits nowhere. Conversations none of
whose rows are left have one row without edit in ``repaired``. Repeated rows are duplicates like
any other. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hodos.llm.common import SPACES, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows whose edits are open before ways are traced back, and rows and characters before blocks go to a file.
OPEN, HELD, HELD_TEXT = 64, 4_096, 1 << 24
FAULTS = (None, "blank", "duplicate", "truncated")
_NONE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
#: Where each state leads: role, its letter, next state. 0 nothing yet, 1 system, 2 user, 3 assistant.
_ROLES = {"u": "user", "a": "assistant"}
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
_ENDS = {0: 0, 1: 2, 2: 1, 3: 0}


def _ways(initial: str, fault: int) -> list[list[tuple[int, int, str, int]]]:
    """For each state after a row the ways into it: (cost, state before, letters, inserts)."""
    into: list[list[tuple[int, int, str, int]]] = [[] for _ in range(4)]
    extra = TRUNCATED if fault == _TRUNCATED else 0
    for start in range(4):
        into[start].append((DELETE, start, "D", 0))
        if fault in (_BLANK, _DUPLICATE):
            continue
        state = start
        for inserts in range(3):
            wanted, cost = _WANTED[state], INSERT * inserts + extra
            if initial in _NEXT[state]:
                into[_NEXT[state][initial]].append((cost + KEEP, start, "I" * inserts + "K", inserts))
            if initial != wanted:
                into[_NEXT[state][wanted]].append((cost + REROLE, start, "I" * inserts + "R", inserts))
            state = _NEXT[state][wanted]
    return into


_LETTERS = "DKR"
_table = {(i, f): _ways(i, f) for i in ("s", "u", "a", "") for f in range(4)}


class Open:
    """Rows whose edits are open and, for each, one byte a state: state before, edit, inserts."""

    def __init__(self):
        self.rows, self.back, self.size = [], bytearray(), 0
        self.file, self.blocks = None, []  # (place of rows, bytes of rows, place of ways, rows) by block

    def add(self, row: tuple, ways: bytes) -> None:
        self.rows.append(row)
        self.back += ways
        self.size += len(row[2])

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        at = self.file.tell()
        rows = pickle.dumps(self.rows, pickle.HIGHEST_PROTOCOL)
        self.file.write(rows)
        self.file.write(bytes(self.back))
        self.blocks.append((at, len(rows), at + len(rows), len(self.rows)))
        self.rows, self.back, self.size = [], bytearray(), 0

    def forced(self, alive: list[int]) -> tuple[int, int]:
        """(number of held rows that all ``alive`` states reach by one way, state after them)."""
        at = set(alive)
        for i in range(len(self.rows) - 1, -1, -1):
            at = {self.back[4 * i + q] & 3 for q in at}
            if len(at) == 1:
                return i, at.pop()
        return 0, -1

    def choices(self, back: bytes, state: int) -> tuple[bytes, int]:
        """(the byte of each row on the way that ends in ``state``, the state it began in)."""
        out = bytearray(len(back) // 4)
        for i in range(len(out) - 1, -1, -1):
            out[i] = back[4 * i + state]
            state = out[i] & 3
        return bytes(out), state

    def drained(self, n: int, state: int):
        """The first ``n`` held rows (and all in the file before them) with their choices, which
        end in ``state``; they are forgotten."""
        part, state = self.choices(self.back[: 4 * n], state)
        for at, size, ways, count in reversed(self.blocks):  # the choices take the place of the ways
            self.file.seek(ways)
            chosen, state = self.choices(self.file.read(4 * count), state)
            self.file.seek(ways)
            self.file.write(chosen)
        for at, size, ways, count in self.blocks:
            self.file.seek(at)
            rows = pickle.loads(self.file.read(size))
            self.file.seek(ways)
            yield from zip(rows, self.file.read(count))
        if self.file:
            self.file.close()
        self.file, self.blocks = None, []
        yield from zip(self.rows[:n], part)
        self.rows, self.back = self.rows[n:], self.back[4 * n :]
        self.size = sum(len(r[2]) for r in self.rows)


class Conversation:
    """The state of one conversation. Rows are (turn, role, text, fault)."""

    def __init__(self):
        self.cost: list = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.open = Open()
        self.state = 0  # after the rows given out
        self.place = 0
        self.patience = OPEN

    def add(self, turn, role: str, text: str, fault: int):
        """Takes a row up and yields the rows decided by it."""
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        cost, rank, new, letters, ways = self.cost, self.rank, [None] * 4, [None] * 4, bytearray(4)
        for state, into in enumerate(_table[initial, fault]):
            least = None
            for add, before, by, inserts in into:
                if cost[before] is not None:
                    key = (cost[before] + add, rank[before], by, before, inserts)
                    if least is None or key < least:
                        least = key
            if least is not None:
                new[state], letters[state] = least[0], (least[1], least[2])
                ways[state] = least[3] | _LETTERS.index(least[2][-1]) << 2 | least[4] << 4
        order = sorted((q for q in range(4) if letters[q]), key=lambda q: letters[q])
        self.cost, self.rank = new, [order.index(q) if letters[q] else 0 for q in range(4)]
        self.open.add((turn, role, text, fault), bytes(ways))
        if len(self.open.rows) >= self.patience or self.open.size > HELD_TEXT:
            n, state = self.open.forced(order)
            if n:
                yield from self._given(n, state)
                self.patience = len(self.open.rows) + OPEN
            else:
                self.patience = min(2 * self.patience, HELD)
            if len(self.open.rows) >= HELD or self.open.size > HELD_TEXT:
                self.open.spill()
                self.patience = OPEN

    def _given(self, n: int, state: int):
        for (turn, role, text, fault), way in self.open.drained(n, state):
            for _ in range(way >> 4):
                yield self._inserted()
            letter = _LETTERS[way >> 2 & 3]
            now = role
            if letter != "D":
                if letter == "R":
                    now = _ROLES[_WANTED[self.state]]
                self.state = _NEXT[self.state][now[:1]]
            self.place += 1
            yield self.place, turn, now, text, letter, role, FAULTS[fault]

    def _inserted(self):
        role = _ROLES[_WANTED[self.state]]
        self.state = _NEXT[self.state][role[0]]
        self.place += 1
        return self.place, None, role, "", "I", None, None

    def finish(self):
        """The rows still open, and the turns the end asks for."""
        _, _, _, state = min((self.cost[q] + INSERT * _ENDS[q], self.rank[q], "I" * _ENDS[q], q) for q in range(4) if self.cost[q] is not None)
        yield from self._given(len(self.open.rows), state)
        for _ in range(_ENDS[state]):
            yield self._inserted()
        if not self.place:
            yield 0, None, None, None, None, None, None


def _plain(values) -> list:
    return [None if pd.isna(v) else v for v in values]


def _numbers(values) -> list:
    """Longs that came as text: pandas would turn longs with nulls into floats."""
    return [None if pd.isna(v) else int(v) for v in values]


_COLUMNS = ["place", "turn", "role", "text", "edit", "given_role", "fault"]
_SCHEMA = "conv_id long, place long, turn long, role string, text string, edit string, given_role string, fault string"


def _whole(values):
    """Longs with nulls, as pandas keeps them without turning them into floats."""
    return pd.array(values, "Int64")


def _streamed(batches):
    """Repaired rows of conversations that arrive one after the other, each in order."""
    current, at = None, None
    out: list[tuple] = []
    size = 0

    def frame():
        columns = list(zip(*out))
        made = pd.DataFrame(dict(zip(["conv_id", *_COLUMNS], columns)))
        for name in ("conv_id", "place", "turn"):
            made[name] = _whole(made[name].tolist())
        return made

    for batch in batches:
        for conv, turn, role, text, fault, gone in zip(_numbers(batch["conv_id"]), _numbers(batch["turn"]), *(batch[c].tolist() for c in ("role", "text", "fault", "gone"))):
            if current is None or conv != at:
                if current is not None:
                    out += [(at, *r) for r in current.finish()]
                current, at = Conversation(), conv
            if not gone:
                for row in current.add(turn, role, text, fault):
                    out.append((at, *row))
                    size += len(row[3] or "")
            if len(out) > HELD or size > HELD_TEXT:
                yield frame()
                out, size = [], 0
    if current is not None:
        out += [(at, *r) for r in current.finish()]
    if out:
        yield frame()


def repaired(rows: DataFrame) -> DataFrame:
    """Rows of ``rows`` (conv_id, turn, role, text; optionally ``gone``, true for rows that only
    name their conversation) as repaired: conv_id, place (from 1), turn, role, text, edit (K, R,
    D or I), given_role (before the edit) and fault (blank, duplicate, truncated or null), deleted
    ones included. The rows of a conversation come together and in order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    named = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    dealt = named.repartition(F.col("conv_id"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn")))
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    last = F.substring(bare, -1, 1)
    fault = F.when(bare == "", _BLANK).when(earlier > 1, _DUPLICATE).when(~last.isin(".", "!", "?"), _TRUNCATED).otherwise(_NONE)
    found = dealt.select("conv_id", "turn", "role", "text", fault.alias("fault"), "gone", earlier.alias("earlier"))
    ordered = found.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "earlier")
    return _as_text(ordered).drop("earlier").mapInPandas(_streamed, _SCHEMA)


def _as_text(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})


def _digested(batches):
    """One row for each conversation of repaired rows that come together and in order."""
    at, now = None, None
    done = []

    def close():
        return (at, now["gaps"], now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], now["audit"].decode(), now["hash"].hexdigest())

    def frame():
        made = pd.DataFrame(done, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])
        for name in made.columns[:7]:
            made[name] = _whole(made[name].tolist())
        return made

    for batch in batches:
        for conv, turn, role, text, edit, was, fault in zip(_numbers(batch["conv_id"]), _numbers(batch["turn"]), *(_plain(batch[c]) for c in ("role", "text", "edit", "given_role", "fault"))):
            if now is None or conv != at:
                if now is not None:
                    done.append(close())
                at, now = conv, {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": bytearray(), "hash": hashlib.sha256(), "turn": None, "initial": None, "any": False}
            if edit is None:
                continue
            now["audit"] += edit.encode()
            now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "I":
                if fault is not None:
                    now[fault] += 1
                now["illegal"] += now["initial"] is not None and now["initial"] + was[:1] not in ("su", "ua", "au")
                now["initial"] = was[:1]
                if turn is not None:
                    now["gaps"] += max(0, turn - now["turn"] - 1) if now["turn"] is not None else 0
                    now["turn"] = turn
            if edit != "D":
                now["hash"].update(("\n" if now["any"] else "").encode() + role.encode() + b":" + text.encode())
                now["any"] = True
        if len(done) > HELD:
            yield frame()
            done = []
    if now is not None:
        done.append(close())
    if done:
        yield frame()


def digests(streamed: DataFrame) -> DataFrame:
    """Counts of gaps, faults and illegal pairs, cost, audit and hash of each conversation of
    what ``repaired`` returns. It has to be that very result: order is not restored here."""
    return _as_text(streamed).mapInPandas(_digested, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of ``conv_id:turn``; dropped ones stay as ``gone``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn: Column = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    named = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), drawn.alias("drawn"))
    text = F.when(F.col("drawn").isin(0, 1), F.lit("")).when(F.col("drawn") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("drawn") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("drawn") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return named.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("drawn") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def conversation_repair(spark, sf_dir: str) -> DataFrame:
    """op12: every conversation of ``conversations`` with its faults, edits and hash after damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(repaired(damaged(rows)))
