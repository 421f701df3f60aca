"""Repair of conversation structure: the cheapest edits that give an allowed order of roles.

A conversation's turns and the grammar ``(s?(ua)+)?`` of role initials span a lattice of
nodes (turn index, grammar state) that is never built: Dijkstra expands it from a heap
whose priority key is (cost, audit), audit being the initials of the edits so far. Each
node is popped once, with its cheapest and, among equals, ASCII-least audit, and the
search stops at the first accepting end node that is popped. Edits: Keep 0, Rerole to
user or assistant 1, Delete 2 (the only way out of a blank or repeated turn), Insert an
empty user or assistant turn 5; a truncated turn that stays adds 5.

One exchange brings the turns of a conversation together, sorted, and they are read as a
stream. A conversation of over ``SEGMENT`` turns is searched a segment at a time: the
search of a segment starts from the states that its predecessor ended in, with their keys,
and ends when every state at its far side is popped, which gives the same result, as keys
only grow. Each of these (at most four) states carries the digest of its repaired text so
far, so no texts are held back. What is held for a conversation is 16 bytes a turn to know
repeats and one letter a turn; its turns meet in one task, because the digest of its
repaired text is sequential by contract.

Defined cases: null roles and texts are one space, in the key of the damage null ids and
turns too; turns of one number stand by role, then text; null turns come first; a role of
no characters fits no state; rows that share everything are repeats of each other; a null
conv_id is a conversation of its own; a conversation that loses all turns has zeros, an
empty audit and the digest of no text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bind

SEGMENT = 1000

#: The grammar of role initials: state -> initial -> state; a conversation may end in START or ANSWERED.
START, OPENED, ASKED, ANSWERED = range(4)
STEPS = {START: {"s": OPENED, "u": ASKED}, OPENED: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
ENDS = (START, ANSWERED)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}

#: What parts words, from space to carriage return, and what may end a sentence.
BREAKS, MARKS = " \t\n\x0b\x0c\r", ".!?"

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@dataclass
class Path:
    """The best way into a state: its cost, its audit beyond what all states share, and the digest of what it has written."""

    cost: int = 0
    audit: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    lines: int = 0

    def write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1


def cross(turns: list[tuple[str, str, int]], entry: dict[int, Path], last: bool) -> dict[int, Path]:
    """Best paths over turns (role, text, fault) from the entry states to every state at the far side, or to the best accepting one if these turns are the last."""
    n, done, out = len(turns), set(), {}
    heap = [(path.cost, path.audit, 0, state, state) for state, path in entry.items()]
    heapq.heapify(heap)
    while heap:
        cost, audit, i, state, source = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (not last or state in ENDS):
            out[state] = replay(turns, entry[source], source, cost, audit)
            if last or len(out) == len(STEPS):
                break
        steps = STEPS[state]
        for initial in ROLES:
            if initial in steps and (i, steps[initial]) not in done:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, steps[initial], source))
        if i < n:
            role, _, fault = turns[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state, source))
            if fault not in (BLANK, DUPLICATE):
                stays = cost + (CUT_OFF if fault == TRUNCATED else 0)
                if role[:1] in steps:
                    heapq.heappush(heap, (stays, audit + "K", i + 1, steps[role[:1]], source))
                for initial in ROLES:
                    if initial in steps:
                        heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, steps[initial], source))
    return out


def replay(turns: list[tuple[str, str, int]], start: Path, state: int, cost: int, audit: str) -> Path:
    """The path that follows these edits; in each state only one of user and assistant fits, so the edits name it."""
    path, i = Path(cost, audit, start.digest.copy(), start.lines), 0
    for edit in audit[len(start.audit) :]:
        if edit == "D":
            i += 1
            continue
        role, text = ("", "") if edit == "I" else turns[i][:2]
        i += edit != "I"
        initial = role[:1] if edit == "K" else next(x for x in ROLES if x in STEPS[state])
        path.write(role if edit == "K" else ROLES[initial], text)
        state = STEPS[state][initial]
    return path


class Conversation:
    """One conversation, turn by turn."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.entry, self.shared = conv_id, [], {START: Path()}, []
        self.seen, self.known = set(), []
        self.first = self.latest = self.before = None
        self.distinct = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def repeated(self, role: str, text: str) -> bool:
        """Whether role and text came before; digests of past segments stand sorted, 16 bytes each."""
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if key in self.seen:
            return True
        one = np.frombuffer(key, "S16")
        if any(keys[min(np.searchsorted(keys, one[0]), len(keys) - 1)] == one[0] for keys in self.known):
            return True
        self.seen.add(key)
        return False

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.repeated(role, text) and fault != BLANK:
            fault = DUPLICATE
        self.faults[fault] += 1
        if turn is not None:
            self.distinct += turn != self.latest
            self.first = turn if self.first is None else self.first
            self.latest = turn
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        if len(self.turns) == SEGMENT:
            self.close_segment()
        self.turns.append((role, text, fault))

    def close_segment(self) -> None:
        self.entry = cross(self.turns, self.entry, last=False)
        self.turns = []
        common = commonprefix([p.audit for p in self.entry.values()])
        self.shared.append(common)
        for path in self.entry.values():
            path.audit = path.audit[len(common) :]
        new = np.sort(np.frombuffer(b"".join(self.seen), "S16"))
        self.seen = set()
        if not len(new):
            return
        while self.known and len(self.known[-1]) <= len(new):  # few sorted runs, each longer than the next
            new = np.sort(np.concatenate([self.known.pop(), new]))
        self.known.append(new)

    def result(self) -> tuple:
        (path,) = cross(self.turns, self.entry, last=True).values()
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.distinct
        return (self.conv_id, gaps, *self.faults[BLANK:], self.illegal, path.cost, "".join([*self.shared, path.audit]), path.digest.hexdigest())


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the sorted turns (conv_id, turn, role, text, fault, times) of a partition; times 0 stands for a turn that is gone."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    now, out = None, []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name in ("audit", "repaired_sha256") else pa.int64()) for name, c in zip(names, columns, strict=True)], names=names)

    for batch in batches:
        for conv_id, turn, role, text, fault, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result())
                now = Conversation(conv_id)
            for _ in range(times):
                now.add(turn, role, text, fault)
        if out:
            yield rows()
    if now is not None:
        out.append(now.result())
        yield rows()


def faulty(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, times) with ``fault``: blank, truncated or neither; repeats are found later."""
    ends = lambda t: F.when(t == "", BLANK).when(F.right(t, F.lit(1)).isin(*MARKS), SOUND).otherwise(TRUNCATED)
    return turns.withColumn("fault", bind(F.rtrim("text", F.lit(BREAKS)), ends))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of turns (conv_id, turn, role, text, times)."""
    sent = faulty(turns).select("conv_id", "turn", "role", "text", "fault", "times")
    return sent.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(repaired, RESULT)


def plain_turns(table: DataFrame) -> DataFrame:
    """The turns of a table as ``repair`` wants them, undamaged."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled, F.lit(1).alias("times"))


def damaged(table: DataFrame) -> DataFrame:
    """Turns damaged by the checksum of "conv_id:turn" modulo 20: 0 is gone, 1 empty, 2 without sentence marks, 3 twice, 4 by a user."""
    conv_id, turn = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = plain_turns(table).withColumn("damage", F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20)
    text = F.when(F.col("damage").isin(0, 1), "").when(F.col("damage") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    times = F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
