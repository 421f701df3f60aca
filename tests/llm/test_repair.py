"""Structure repair against a plain table of best edits, with the awkward rows of its contract."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quern.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, fault string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    """Damaged (turn, role, text) of one conversation in order."""
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.strip(BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_edits(rows, marks):
    """Every state's least (cost, audit, lines), row by row; up to two turns may be put in anywhere."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put_in(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                for x in "ua":
                    if x in legal[state]:
                        new = (cost + 5, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[x]])
                        if x not in out or new[:2] < out[x][:2]:
                            out[x] = new
        return out

    states = put_in({"": (0, "", [])})
    for (_, role, text), mark in zip(rows, marks, strict=True):
        after = {}

        def offer(state, *new, after=after):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, lines) in states.items():
            offer(state, cost + 2, audit + "D", lines)
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                if role[:1] and role[:1] in legal[state]:
                    offer(role[0], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in legal[state]:
                        offer(x, cost + more + 1, audit + "R", [*lines, f"{name}:{text}"])
        states = put_in(after)
    return min((states[s] for s in ("", "a") if s in states), key=lambda r: r[:2])


def brute(rows):
    """conv_id -> the contract's columns."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = damage([r for r in rows if r[0] == conv])
        marks = faults(left)
        turns = [t for t, _, _ in left if t is not None]
        cost, audit, lines = best_edits(left, marks)
        assert GRAMMAR.fullmatch("".join(line[0] for line in lines))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(frame):
    rows = frame.collect()
    out = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No", "What?", "Yes.", " \n ", "", None, "Good. \t", "漢字!", "a" * 50]
    rows = []
    for conv in range(convs):
        turn = rng.randrange(3)
        for i in range(rng.randrange(1, longest)):
            text = rng.choice(texts)
            rows.append((conv, rng.choice([turn, None]) if rng.random() < 0.2 else turn, rng.choice(roles), f"{text} {i}." if text and rng.random() < 0.6 else text))
            turn += rng.choice([0, 1, 1, 1, 2])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def test_matches_brute_force(spark):
    rows = made(1, 400, 14)
    assert found(repair.repair(repair.damaged(frame(spark, rows)))) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "Without an id."), (None, 2, "assistant", "Well."), (7, None, None, None), (7, None, "user", "a."), (8, 3, "user", "x."), (8, 3, "user", "x."), (9, 1, "system", "Only."), (-4, -2, "user", "y" * 300_000 + "."), (-4, -1, "assistant", "z." * 100_000)]
    gone = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    got = found(repair.repair(repair.damaged(frame(spark, rows))))
    assert got == brute(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repair.repair(repair.damaged(frame(spark, []))).count() == 0


@pytest.mark.parametrize("segment", [1, 2, 5])
def test_segments_change_nothing(segment, monkeypatch):
    rng = random.Random(segment)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", f"{i}.", f"{i}", ""])) for i in range(rng.randrange(40))]
        results = []
        for size in (segment, 1000):
            monkeypatch.setattr(repair, "SEGMENT", size)
            conv = repair.Conversation(1)
            for turn, role, text in rows:
                conv.add(turn, role, text, repair.SOUND if text.endswith(".") else repair.TRUNCATED if text else repair.BLANK)
            results.append(conv.result())
        assert results[0] == results[1]
        cost, audit, lines = best_edits(rows, faults(rows))
        assert results[0][-3:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_a_hot_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i % 3000}.") for i in range(9000)] + made(5, 30, 6)
    rows = [r if r[0] == 1 or r[0] is None else (r[0] + 10, *r[1:]) for r in rows]
    assert found(repair.repair(repair.damaged(frame(spark, rows)))) == brute(rows)
