"""Repairs against a plain search over all edits, and the query against a row-by-row version."""

import hashlib
import random
import re
import zlib

import pytest

from touchline.llm.conversations import conversation_report, edits, repair, target

SCHEMA = "conv_id long, turn long, role string, text string, rn int, cost string, audit int, `a.b` int"


def plain_repair(turns):
    """All states (turns used, letters made) from the end, with the least (cost, audit) of each, for every target length."""
    best = None
    for length in [0, *range(2, 2 * len(turns) + 4)]:
        want, togo = target(length), {}
        for i in range(len(turns), -1, -1):
            for j in range(length, -1, -1):
                options = [(0, "")] if (i, j) == (len(turns), length) else []
                if i < len(turns):
                    options.append((4 + togo[i + 1, j][0], "D" + togo[i + 1, j][1]))
                if j < length and want[j] != "s":
                    options.append((3 + togo[i, j + 1][0], "I" + togo[i, j + 1][1]))
                if i < len(turns) and j < length and turns[i] != "-":
                    cost, rest = togo[i + 1, j + 1]
                    cost += 3 * turns[i].isupper()
                    if turns[i].lower() == want[j]:
                        options.append((cost, "K" + rest))
                    elif want[j] != "s":
                        options.append((cost + 3, "R" + rest))
                togo[i, j] = min(options, default=(1 << 30, ""))
        best = min(filter(None, [best, togo[0, 0]]))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_repair_is_the_cheapest_and_least(n):
    draw = random.Random(n)
    for _ in range(150 if n < 9 else 25):
        turns = "".join(draw.choice("suuuaaaxSUA--") for _ in range(n))
        assert repair(turns) == plain_repair(turns), turns


def test_long_conversations_stay_in_the_band():
    draw = random.Random(7)
    turns = "".join(draw.choice("ua" if draw.random() < 0.15 else "ua"[i % 2]) for i in range(600))
    cost, audit = repair("s" + turns)
    assert audit[0] == "K" and cost < 600 and len(edits("s" + turns, audit)) == len(audit)
    assert sum(x != "I" for x in audit) == 601


def plain_report(rows):
    """Contract by hand: damage, order, faults, repair, hash."""
    convs = {}
    for conv, turn, role, text in rows:
        live = convs.setdefault(conv, [])
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        drawn = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if drawn == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(drawn, text)
        live += [(turn, "user" if drawn == 4 else role, text)] * (2 if drawn == 3 else 1)
    out = []
    for conv, live in convs.items():
        live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, counts, letters = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), ""
        for _, role, text in live:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if fault:
                counts[fault] += 1
            letters += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(live, live[1:]))
        turns = {t for t, _, _ in live if t is not None}
        cost, audit = plain_repair(letters)
        lines = []
        for at, letter, role in edits(letters, audit):
            if letter == "I":
                lines.append(f"{role}:")
            elif letter != "D":
                lines.append(f"{role or live[at - 1][1]}:{live[at - 1][2]}")
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    draw, rows = random.Random(3), []
    says = ["Hello there.", "Why?", "", " \t\x0b", None, "no end", "Yes! ", "So it is.\n\x0c", "A.B", "\xa0", "long " * 3000 + "."]
    for conv in [*range(60), None]:
        for turn in range(draw.randrange(9)):
            at = None if draw.random() < 0.1 else turn + (draw.random() < 0.1) * 3
            rows.append((conv, at, draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), draw.choice(says)))
    return rows + rows[:5] + [(900, t, "user", "x.") for t in range(1) if True]


def test_report_equals_the_plain_version(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, conversation_report(df).collect()), key=repr)
    assert got == plain_report(rows)
    assert len({len(g[7]) for g in got}) > 4


def test_conversations_without_rows_after_damage(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x", 1, "c", 2, 3)], SCHEMA)
    assert [tuple(r) for r in conversation_report(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_report(df.limit(0)).count() == 0
