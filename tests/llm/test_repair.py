"""Conversation repair against a plain search over all edits, and over awkward tables."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from hypothesis import given, settings, strategies as st

from broadsheet.llm import repair
from broadsheet.llm.common import importable
from broadsheet.llm.queries import op11_repair

STEPS = st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from([0, 0, 0, 1, 2])), max_size=9)


def least(steps, entry, goals):
    """Least (cost, audit) per state, turn by turn: every edit of every turn is tried."""
    never = (10**9, "")
    ways = [never] * 4
    ways[entry] = (0, "")

    def inserted(ways):
        for _ in range(3):
            for state, to in enumerate(repair._NEXT):
                ways[to] = min(ways[to], (ways[state][0] + 3, ways[state][1] + "I"))
        return ways

    ways = inserted(ways)
    for initial, fault in steps:
        new = [(c + 4, a + "D") for c, a in ways]
        if fault != repair.DOOMED:
            more = 3 * (fault == repair.CUT)
            for state, (c, a) in enumerate(ways):
                to = 3 if state == 2 else 2
                new[to] = min(new[to], (c + 3 + more, a + "R"))
                kept = {"s": 1, "u": 2, "a": 3}.get(initial)
                if kept == to or (kept == 1 and state == 0):
                    new[kept] = min(new[kept], (c + more, a + "K"))
        ways = inserted(new)
    found = min(ways[g] for g in goals)
    return found if found[0] < 10**8 else None


@settings(max_examples=400, deadline=None)
@given(STEPS, st.sampled_from([0, 1, 2, 3]), st.sampled_from([{0, 3}, {0}, {1}, {2}, {3}]))
def test_branch_and_bound_finds_the_least_edits(steps, entry, goals):
    assert repair.branch_and_bound(steps, entry, goals) == least(steps, entry, goals)


def test_long_conversations_stay_cheap():
    draw = random.Random(1)
    for initials in ("u", "a", "s", "uuaas", "t"):
        steps = [(draw.choice(initials), draw.choice([0, 0, 0, 0, 1, 2])) for _ in range(2_000)]
        for entry in range(4):
            for goals in ({0, 3}, {0}, {1}, {2}, {3}):
                assert repair.branch_and_bound(steps, entry, goals) == least(steps, entry, goals)


@settings(max_examples=100, deadline=None)
@given(STEPS)
def test_bounds_are_never_above_what_the_rest_costs(steps):
    bounds = repair.suffix_bounds(steps)
    for at in range(len(steps) + 1):
        for state in range(4):
            for goals in ({0, 3}, {2}, {3}):
                rest = least(steps[at:], state, goals)
                assert rest is None or bounds[at][state] <= rest[0]


def brute(rows):
    """The contract, read plainly, over ``(conv_id, turn, role, text)`` after damage."""
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    place = lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())
    out = {}
    for conv_id, own in groupby(sorted(rows, key=place), key=lambda r: r[0]):
        own, seen, steps, counts = list(own), set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            steps.append((role[:1], 2 if fault in ("blank", "duplicate") else 1 if fault else 0))
        turns = [t for _, t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = least(steps, 0, {0, 3})
        turn, kept = iter(own), []
        for letter in audit:
            row = None if letter == "I" else next(turn)
            if letter == "D":
                continue
            led = bool(kept) and kept[0][0][:1] == "s"
            role = row[2] if letter == "K" else ("user", "assistant")[(len(kept) - led) % 2]
            kept.append((role, row[3] if row else ""))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in kept))
        text = "\n".join(f"{r}:{x}" for r, x in kept)
        out[conv_id] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def as_dict(found):
    rows = found.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in rows}


LONG = "word " * 60_000
AWKWARD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes?"), (1, 1, "assistant", "Yes?"), (1, 5, "user", "  \n"),
    (2, None, None, None), (2, None, "user", "A!"), (2, 3, "", "Empty role."), (2, 9, "tool", "Cut"),
    (None, 0, "system", "S."), (None, 1, "user", LONG), (None, 2, "assistant", LONG + "."),
    (3, -5, "system", "S."), (3, 2**62, "system", "S."), (4, 0, "assistant", "a." ), (4, 0, "user", "u."), (4, 0, "user", "v."),
]


@pytest.fixture(scope="module")
def conversations(spark):
    importable(spark)
    draw = random.Random(3)
    rows = AWKWARD + [
        (c, t, draw.choice(["user", "user", "assistant", "system"]), draw.choice(["One.", "Two", "Three!", "", "Four?"]))
        for c in range(10, 40) for t in range(draw.randrange(1, 12))
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'x' AS audit", "1 AS task", "map('k', 1) AS ways"
    ).repartition(3), rows


def test_awkward_conversations(spark, conversations):
    table, rows = conversations
    assert as_dict(repair.repair(table)) == brute(rows)
    assert repair.repair(table.limit(0)).count() == 0


def test_conversations_cut_into_segments_over_many_tasks(spark, conversations, monkeypatch):
    _, rows = conversations
    draw = random.Random(9)
    rows = rows + [
        (77, t, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice([f"{t}.", f"{t}", "Again."])) for t in range(700)
    ]
    monkeypatch.setattr(repair, "SEGMENT", 7)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_dict(repair.repair(table)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_damage_follows_the_checksum(conversations):
    table, rows = conversations
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            want += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in repair.damage(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) < len(rows) + 10


def test_repaired_turns_are_given_in_order(spark, conversations):
    table, rows = conversations
    planned = repair.plans(table)
    turns = repair.repaired(table, planned).collect()
    want = brute(rows)
    for conv_id, own in groupby(sorted(turns, key=lambda r: (str(r.conv_id), r.position)), key=lambda r: r.conv_id):
        own = list(own)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        text = "\n".join(f"{r.role}:{r.text}" for r in own)
        assert hashlib.sha256(text.encode()).hexdigest() == want[conv_id][-1]


def test_every_conversation_has_a_row(spark, sf_dir):
    found = op11_repair(spark, sf_dir)
    every = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    assert found.count() == every.count() and found.filter("audit = ''").filter("cost > 0").count() == 0
