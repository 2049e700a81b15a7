"""Conversation repair against every sequence of edits, and damage by hand."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from leafmill.llm import turns


def every_repair(initials: str, faults: str) -> tuple[int, str]:
    """The least (cost, audit) over all edits of every row and up to two rows put in at every place."""
    ways = []
    for initial, fault in zip(initials, faults, strict=True):
        own = [("D", "", 2)]
        if fault in ".t":
            more = 5 if fault == "t" else 0
            own += [("K", initial, more)] + [("R", given, 1 + more) for given in "ua"]
        ways += [[("", "", 0)] + [("I" * len(x), x, 5 * len(x)) for x in ("u", "a", "ua", "au")], own]
    ways.append([("", "", 0)] + [("I" * len(x), x, 5 * len(x)) for x in ("u", "a", "ua", "au")])
    best = None
    for edits in product(*ways):
        if re.fullmatch("(s?(ua)+)?", "".join(e[1] for e in edits)):
            value = (sum(e[2] for e in edits), "".join(e[0] for e in edits))
            best = value if best is None or value < best else best
    return best


@pytest.mark.parametrize("size", [0, 1, 2, 3])
def test_parse_is_the_least_of_all_repairs(size):
    for initials in product("sua-", repeat=size):
        for faults in product(".tbd", repeat=size) if size < 3 else (random.Random("".join(initials)).choices(".tbd", weights=(5, 3, 1, 1), k=3) for _ in range(3)):
            got = turns.parsed("".join(initials), "".join(faults))
            assert got == every_repair("".join(initials), "".join(faults)), (initials, faults)


def test_long_conversation():
    cost, audit = turns.parsed("s" + "ua" * 4000 + "u", "." * 8002)
    assert (cost, audit) == (2, "K" * 8001 + "D")
    assert turns.parsed("u" * 2000, "." * 2000)[0] == 1000


def brute(rows: list[tuple]) -> dict:
    out: dict = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    report = {}
    for conv, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = "", set()
        for _, role, text in own:
            kept = text.rstrip(" \t\n\v\f\r")
            faults += "b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "."
            seen.add((role, text))
        initials = "".join(r[1][:1] if r[1][:1] in ("s", "u", "a") else "-" for r in own)
        cost, audit = turns.parsed(initials, faults)
        lines, at, first = [], 0, True
        expect = "u"
        for edit in audit:
            _, role, text = (None, None, None) if edit == "I" else own[at]
            at += edit != "I"
            if edit == "D":
                continue
            if edit == "K":
                lines.append(f"{role}:{text}")
                expect = "u" if first and role[0] == "s" else "a" if role[0] == "u" else "u"
            else:
                lines.append(("user" if expect == "u" else "assistant") + ":" + (text or ""))
                expect = "a" if expect == "u" else "u"
            first = False
        numbers = [t for t, _, _ in own if t is not None]
        raw = [r[1][:1] for r in own]
        report[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(k) for k in "bdt"),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(raw, raw[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return report


def test_report_by_hand(spark):
    rng = random.Random(5)
    roles = ("system", "user", "assistant", "assistant", "user", "tool", "", None)
    rows = []
    for conv in [*range(120), None]:
        for turn in rng.sample(range(14), rng.randrange(1, 7)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(("Yes.", "No!  ", "cut off", "", None, " \t", "a\nb?", "Über."))))
    rows += rows[:9] + [(500, 1, "user", "word " * 50_000), (500, 2, "assistant", "x" * 200_000 + "."), (501, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, audit string").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in turns.report(frame.select("conv_id"), turns.damaged(frame)).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.report(frame.select("conv_id"), turns.damaged(frame)).collect() == []
