"""Conversation repair against a search over all edits, on whole conversations and on long ones in pieces."""

import hashlib
import random
import zlib

import pytest

from tidewater.llm import conversations as c

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, piece string, cost string, rows string"


def cheapest(rows):
    """Cost and audit of the cheapest edits, by a search from the end over (row, state): no targets, no bands, no pieces.

    rows: (initial, truncated, must be deleted)."""
    expects = {"0": "su", "s": "u", "u": "a", "a": "u"}
    n = len(rows)
    # inserts after the last row: none, one or two of them reach the end
    after = {"0": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    for i in range(n - 1, -1, -1):
        initial, truncated, doomed = rows[i]
        step = {}
        for state in "0sua":
            options = [(4 + after[state][0], "D" + after[state][1])]
            if not doomed:
                more = 3 if truncated else 0
                for role in expects[state]:
                    if initial == role:
                        options.append((more + after[role][0], "K" + after[role][1]))
                    if role != "s":
                        options.append((more + 3 + after[role][0], "R" + after[role][1]))
            step[state] = min(options)
        here = dict(step)
        for _ in range(3):  # an insert leads to the next state before the same row
            for state in "0sua":
                role = "a" if state == "u" else "u"
                here[state] = min(here[state], (3 + here[role][0], "I" + here[role][1]))
        after = here
    return after["0"]


def plain(rows):
    """What the query returns for the damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = cheapest([(role[:1], fault == "truncated", fault in ("blank", "duplicate")) for (_, role, _), fault in zip(rows, faults, strict=True)])
    out, at, state = [], 0, "0"
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        expected = "assistant" if state == "u" else "user"
        role, text = (expected, "") if edit == "I" else (rows[at][1] if edit == "K" else expected, rows[at][2])
        at += edit != "I"
        state = role[0]
        out.append(f"{role}:{text}")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return {"gaps": gaps, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def expected(rows, hurt=True):
    left = damage(rows) if hurt else rows
    return {conv: plain([r[1:] for r in left if r[0] == conv]) for conv in {r[0] for r in rows}}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def digests(found):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found}


def conversation(r, conv, n):
    rows = []
    for turn in range(n):
        role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[turn % 2]
        if r.random() < 0.1:
            role = r.choice(["system", "tool", "", "unknown", "Assistant", None])
        text = r.choice(["Yes.", "No", "What?", f"Word {turn}.", f"word {turn}", "", " \n", "end!\t", None, "é ü!"])
        rows.append((conv, r.choice([turn, turn, turn, turn + r.randint(0, 2), None]), role, text))
    return rows


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13, 40])
def test_alignment(n):
    r = random.Random(n)
    for _ in range(300 if n < 14 else 12):
        rows = "".join(r.choice("uuaassuaxUAX-") for _ in range(n))
        marks = [("" if x == "-" else x.lower(), x.isupper(), x == "-") for x in rows]
        assert c.repair(rows) == cheapest(marks)


def test_pieces_are_one(spark):
    r = random.Random(7)
    for n in (1, 5, 30):
        rows = "".join(r.choice("uauauasx-U") for _ in range(n))
        for cut in range(1, n):
            parts = [c.matrix(x) for x in (rows[:cut], rows[cut:])]
            whole = c.matrix(rows)
            numbers = c.folded([p[0] for p in parts])
            assert numbers == whole[0]
            last = c._last(numbers)
            states = c.parted([p[0] for p in parts], 0, last)
            assert "".join(p[1][a * c.N + b] for p, (a, b) in zip(parts, states, strict=True)) == whole[1][last]


def test_odd_conversations(spark):
    r = random.Random(3)
    rows = [x for conv in range(60) for x in conversation(r, conv, r.randint(1, 9))]
    rows += [(None, t, "user", "Who?") for t in range(4)] + [(None, None, None, None)] + rows[5:9]
    rows += [(900, t, "user", "x" * 300_000 + ".") for t in range(3)]
    rows += [(901 + i, 0, "user", "Alone.") for i in range(40)]
    found = digests(c.repair_digest(c.damaged(frame(spark, rows)), there="there").collect())
    assert found == expected(rows)
    assert any(d["audit"] == "" for d in found.values())


def test_long_conversations(spark, monkeypatch):
    r = random.Random(5)
    rows = conversation(r, None, 300) + conversation(r, 1, 200) + conversation(r, 2, 7) + [(3, 5, "user", "Same.")] * 150 + [(4, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(90)]
    monkeypatch.setattr(c, "FOLD", 3)
    turns = frame(spark, rows)
    found = digests(c.repair_digest(turns).collect())
    assert found == expected([(a, b, " " if x is None else x, " " if y is None else y) for a, b, x, y in rows], hurt=False)
    edits = c.repaired_turns(turns).orderBy("conv_id", "piece", "place").collect()
    for conv, d in found.items():
        mine = [e for e in edits if e["conv_id"] == conv]
        assert "".join(e["edit"] for e in mine) == d["audit"]
        assert hashlib.sha256("\n".join(f"{e['role']}:{e['text']}" for e in mine if e["edit"] != "D").encode()).hexdigest() == d["repaired_sha256"]


def test_empty_table(spark):
    assert c.repair_digest(c.damaged(frame(spark, []))).count() == 0
    assert c.repaired_turns(frame(spark, [])).count() == 0
