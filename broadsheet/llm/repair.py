"""Conversation structure repair: depth-first branch and bound over the edits of each conversation.

A repaired conversation reads ``(system? (user assistant)+)?``. What has been read so far is one of
four states: nothing, a system turn, a user turn last, an assistant turn last.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from broadsheet.llm.common import written

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
# How a turn may be dealt with: as it is, cut short, or by deletion only.
SOUND, CUT, DOOMED = range(3)
BLANKS = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")
# Turns that are solved at once; longer conversations are chained from such segments.
SEGMENT = 2_000
_REACHES = {EMPTY: {0, 1, 2, 3}, SYSTEM: {1, 2, 3}, USER: {2, 3}, ASSISTANT: {2, 3}}
# A user turn may follow anything but a user turn; an assistant turn follows a user turn.
_NEXT = (USER, USER, ASSISTANT, USER)
_NEVER = 1 << 60
_GIVEN = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _moves(state: int, step: tuple[str, int]) -> list[tuple[str, int, int]]:
    """``letter, cost, next state`` for a turn ``(initial, fault)`` met in a state, by letter."""
    initial, fault = step
    found = [("D", DELETE, state)]
    if fault != DOOMED:
        more = TRUNCATED if fault == CUT else 0
        follower = _NEXT[state]
        kept = _GIVEN.get(initial)
        if kept == follower or (kept == SYSTEM and state == EMPTY):
            found.append(("K", KEEP + more, kept))
        found.append(("R", REROLE + more, follower))
    return found


def suffix_bounds(steps: list[tuple[str, int]]) -> list[tuple[int, int, int, int]]:
    """Least cost of getting past the steps from each on, per state, wherever that ends.

    How a conversation must end is left out, so no real cost is lower and few are much higher.
    """
    bounds = [(0, 0, 0, 0)]
    for step in reversed(steps):
        after = bounds[-1]
        past = [min(cost + after[to] for _, cost, to in _moves(s, step)) for s in range(4)]
        user, assistant = min(past[2], INSERT + past[3]), min(past[3], INSERT + past[2])
        bounds.append((min(past[0], INSERT + user), min(past[1], INSERT + user), user, assistant))
    return bounds[::-1]


def _audit(path) -> str:
    letters = []
    while path:
        letter, path = path
        letters.append(letter)
    return "".join(reversed(letters))


def _descent(steps, bounds, entry: int, goals: set[int]) -> tuple[int, str]:
    """A first incumbent: the edits that the bounds point to, then insertions up to a goal."""
    state, cost, letters = entry, 0, []
    for at, step in enumerate(steps):
        choices = [
            (own + bounds[at + 1][to], letter, own, to)
            for letter, own, to in _moves(state, step)
            if _REACHES[to] & goals
        ]
        follower = _NEXT[state]
        if _REACHES[follower] & goals:
            choices += [
                (INSERT + own + bounds[at + 1][to], "I" + letter, INSERT + own, to)
                for letter, own, to in _moves(follower, step)
                if letter != "D" and _REACHES[to] & goals
            ]
        if not choices:
            return _NEVER, ""
        _, letter, own, state = min(choices)
        cost += own
        letters.append(letter)
    for _ in range(3):
        if state in goals:
            return cost, "".join(letters)
        state, cost = _NEXT[state], cost + INSERT
        letters.append("I")
    return _NEVER, ""


def branch_and_bound(steps: list[tuple[str, int]], entry: int, goals: set[int]) -> tuple[int, str] | None:
    """Least ``(cost, audit)`` that leads from a state past all steps to a goal; None without any.

    Nodes are (step, state). Children are pushed so that they are taken in the order of their
    letters: paths come in ASCII order, so of two that meet in a node at the same cost the first
    has the lesser audit, and the node's table needs no more than its least cost.
    """
    if not _REACHES[entry] & goals:
        return None
    bounds, size = suffix_bounds(steps), len(steps)
    best = _descent(steps, bounds, entry, goals)
    reached = False  # the incumbent is a path that was taken, so equal ones after it are greater
    table = [_NEVER] * (4 * (size + 1))
    stack = [(0, entry, 0, None)]
    while stack:
        at, state, cost, path = stack.pop()
        least = cost + bounds[at][state]
        if least > best[0] or (reached and least == best[0]) or cost >= table[4 * at + state]:
            continue
        table[4 * at + state] = cost
        if at == size and state in goals:
            found = (cost, _audit(path))
            if found <= best:
                best, reached = found, True
            continue
        moves = _moves(state, steps[at]) if at < size else []
        inserted = ("I", INSERT, _NEXT[state])
        for letter, own, to in sorted([*moves, inserted], reverse=True):
            if _REACHES[to] & goals:
                stack.append((at if letter == "I" else at + 1, to, cost + own, (letter, path)))
    return best if best[0] < _NEVER else None


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by the checksum of ``conv_id:turn``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _turns(rows: DataFrame) -> DataFrame:
    """The columns that count, nulls as one blank, with a digest that stands for the text."""
    texts = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *texts).withColumn(
        "digest", F.unhex(F.sha2("text", 256))
    )


ORDER = ("conv_id", "turn", "role", "digest")


def judged_turns(rows: DataFrame) -> DataFrame:
    """Equal turns as one row with their number ``n``: ``blank``, ``cut``, and whether they are the first.

    Partial aggregates take equal rows together before they are shuffled. Texts that come back at
    another turn are found by aggregates as well, so one much repeated text is no hot key.
    """
    ended = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    flags = _turns(rows).select(*ORDER, (ended == "").alias("blank"), (~ended.isin(".", "!", "?")).alias("cut"))
    turns = written(flags.groupBy(*ORDER).agg(F.count("*").alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut")), "turns")
    again = (
        turns.groupBy("conv_id", "role", "digest")
        .agg(F.count("*").alias("times"), F.min(F.struct(F.col("turn").isNotNull().alias("dated"), "turn"))["turn"].alias("earliest"))
        .filter("times > 1").alias("again")
    )
    same = [F.col(f"turns.{c}").eqNullSafe(F.col(f"again.{c}")) for c in ("conv_id", "role", "digest")]
    joined = turns.alias("turns").join(again, same[0] & same[1] & same[2], "left")
    first = F.col("times").isNull() | F.col("turns.turn").eqNullSafe(F.col("earliest"))
    return joined.select("turns.*", first.alias("first"))


_SEGMENT = (
    "task int, seq int, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, ways array<struct<entry:int,exit:int,cost:long,audit:string>>"
)
_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return [(n, kinds.get(k, _WAYS)) for n, k in (f.split(" ", 1) for f in schema.split(", "))]


class _Segment:
    """Turns of one conversation that stand together in one task."""

    def __init__(self, conv_id, task: int, seq: int, entries):
        self.row = {"conv_id": conv_id, "task": task, "seq": seq, "blank": 0, "duplicate": 0, "truncated": 0}
        self.row |= {"illegal": 0, "first": None, "last": None, "low": None, "high": None, "turns": 0}
        self.entries, self.steps = entries, []

    def add(self, turn, initial: str, fault: int) -> None:
        row = self.row
        if row["first"] is None:
            row["first"] = initial
        else:
            row["illegal"] += row["last"] + initial not in LEGAL
        row["last"] = initial
        if turn is not None and turn != row["high"]:
            row["low"] = turn if row["low"] is None else row["low"]
            row["high"], row["turns"] = turn, row["turns"] + 1
        self.steps.append((initial, fault))

    def solved(self, ended: bool) -> dict:
        goals = [{EMPTY, ASSISTANT}] if ended else [{s} for s in range(4)]
        ways = []
        for entry in self.entries:
            for goal in goals:
                if (found := branch_and_bound(self.steps, entry, goal)) is not None:
                    ways.append({"entry": entry, "exit": max(goal), "cost": found[0], "audit": found[1]})
        return self.row | {"ways": ways}


def _segments(turns: DataFrame) -> DataFrame:
    """Every conversation cut where tasks meet and after ``SEGMENT`` turns, each part solved.

    Turns are dealt out by ranges of conversation and turn, so a conversation that holds a large
    share of all turns lies over many tasks. Of a part that may go on elsewhere, the best way from
    every state to every state is kept.
    """
    spread = turns.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions(*ORDER)
    fields = [("conv_id", None), *_fields(_SEGMENT)]

    def run(batches):
        task, open_segment, conv_type, count = TaskContext.get().partitionId(), None, None, 0

        def table(rows: list[dict]) -> pa.RecordBatch:
            kinds = pa.schema([(n, k or conv_type) for n, k in fields])
            return pa.RecordBatch.from_pylist(rows, kinds)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            names = ("conv_id", "turn", "role", "n", "blank", "cut", "first")
            done = []
            for conv_id, turn, role, n, blank, cut, first in zip(*(batch.column(c).to_pylist() for c in names)):
                if open_segment is None or open_segment.row["conv_id"] != conv_id:
                    # The first conversation of a task may have begun in the one before.
                    entries = range(4) if open_segment is None else [EMPTY]
                    if open_segment is not None:
                        done.append(open_segment.solved(True))
                    count, open_segment = 0, _Segment(conv_id, task, 0, entries)
                initial = role[:1]
                for copy in range(n):
                    if len(open_segment.steps) == SEGMENT:
                        done.append(open_segment.solved(False))
                        count += 1
                        open_segment = _Segment(conv_id, task, count, range(4))
                    if blank:
                        fault, name = DOOMED, "blank"
                    elif copy or not first:
                        fault, name = DOOMED, "duplicate"
                    else:
                        fault, name = (CUT, "truncated") if cut else (SOUND, None)
                    if name:
                        open_segment.row[name] += 1
                    open_segment.add(turn, initial, fault)
                if len(done) >= 1_000:
                    yield table(done)
                    done = []
            if done:
                yield table(done)
        if open_segment is not None:
            yield table([open_segment.solved(False)])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return spread.mapInArrow(run, f"conv_id {kind}, {_SEGMENT}")


_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Chain:
    """Segments of one conversation put together in order."""

    def __init__(self, conv_id):
        self.conv_id, self.counts = conv_id, dict.fromkeys(_COUNTS, 0)
        self.last = self.low = self.high = None
        self.turns, self.settled, self.ways = 0, [], {EMPTY: (0, "")}

    def add(self, row: dict) -> None:
        for name in _COUNTS:
            self.counts[name] += row[name]
        if self.last is not None:
            self.counts["illegal"] += self.last + row["first"] not in LEGAL
        self.last = row["last"]
        if row["low"] is not None:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        found: dict[int, tuple[int, str]] = {}
        for way in row["ways"]:
            if way["entry"] in self.ways:
                cost, audit = self.ways[way["entry"]]
                new = (cost + way["cost"], audit + way["audit"])
                found[way["exit"]] = min(new, found.get(way["exit"], new))
        # What all ways have in common is settled; only the rest is compared and copied again.
        shared = len(commonprefix([audit for _, audit in found.values()]))
        self.settled.append(next(iter(found.values()))[1][:shared])
        self.ways = {s: (cost, audit[shared:]) for s, (cost, audit) in found.items()}

    def plan(self) -> dict:
        closing = [(EMPTY, 0, ""), (ASSISTANT, 0, ""), (USER, INSERT, "I"), (SYSTEM, 2 * INSERT, "II")]
        cost, rest = min((self.ways[s][0] + more, self.ways[s][1] + i) for s, more, i in closing if s in self.ways)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        gaps = gaps if gaps < 2**63 else None
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": cost, "audit": "".join([*self.settled, rest])}


def plans(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of conversations with rows.

    ``rows`` has ``conv_id, turn, role, text``; turns are taken by ``turn`` (nulls first), then role
    and the text's digest. A null role or text is one blank, a null ``conv_id`` a conversation of its
    own; other columns are ignored. The counts are of first faults; ``audit`` holds the initials of
    the cheapest edits, the ASCII-least of them. A turn with an empty role cannot be kept as it is.
    ``gaps`` beyond 64 bits is null. An empty table has no conversations.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    parts = _segments(judged_turns(rows)).repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq")
    fields = [("conv_id", None), *_fields(_PLAN)]

    def run(batches):
        chain = None
        for batch in batches:
            kinds = pa.schema([(n, k or batch.schema.field("conv_id").type) for n, k in fields])
            done = []
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                if chain is None or chain.conv_id != row["conv_id"]:
                    if chain is not None:
                        done.append(chain.plan())
                    chain = _Chain(row["conv_id"])
                chain.add(row)
            yield pa.RecordBatch.from_pylist(done, kinds)
        if chain is not None:
            yield pa.RecordBatch.from_pylist([chain.plan()], kinds)

    return parts.mapInArrow(run, f"conv_id {kind}, {_PLAN}")


def _walk(batches, names: list[str]):
    """``(plan or None, position, role, text)`` of repaired turns, each conversation led by its plan."""
    letters, tail, at, position, state = "", 0, 0, 0, EMPTY
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for row in range(batch.num_rows):
            if not columns["_turn"][row].as_py():
                plan = {n: columns[n][row].as_py() for n in names}
                letters, at, position, state = plan["audit"] or "", 0, 0, EMPTY
                tail = len(letters.rstrip("I"))  # insertions behind the last turn
                yield plan, 0, None, None
            else:
                # Edits up to and with the one that deals with this turn.
                edit = letters[at]
                while edit == "I":
                    state, position, at = _NEXT[state], position + 1, at + 1
                    yield None, position, "user" if state == USER else "assistant", ""
                    edit = letters[at]
                at += 1
                if edit != "D":
                    role = columns["role"][row].as_py()
                    if edit == "R":
                        state = _NEXT[state]
                        role = "user" if state == USER else "assistant"
                    else:
                        state = _GIVEN[role[:1]]
                    position += 1
                    yield None, position, role, columns["text"][row].as_py()
                while tail <= at < len(letters):
                    state, position, at = _NEXT[state], position + 1, at + 1
                    yield None, position, "user" if state == USER else "assistant", ""


def _led(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Turns of each conversation behind its plan, one conversation in one task, streamed in order.

    A task holds the letters of one conversation and a batch of turns, however long it is.
    """
    turns = _turns(rows).withColumn("_turn", F.lit(1))
    heads = planned.withColumn("_turn", F.lit(0))
    together = heads.unionByName(turns, allowMissingColumns=True)
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "turn", "role", "digest")


def _streamed(rows: DataFrame, planned: DataFrame, schema: str, results) -> DataFrame:
    """What ``results`` makes of the walk over all conversations, in batches of a thousand rows."""
    names = planned.columns

    def run(batches):
        kinds: dict[str, pa.DataType] = {}

        def watched():
            for batch in batches:
                kinds.update({f.name: f.type for f in batch.schema})
                yield batch

        done = []
        for row in results(_walk(watched(), names)):
            done.append(row)
            if len(done) == 1_000:
                yield _table(done, kinds)
                done = []
        if done:
            yield _table(done, kinds)

    return _led(rows, planned).mapInArrow(run, schema)


def _table(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    own = {"position": pa.int64(), "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, own.get(n) or kinds[n]) for n in rows[0]]))


def _turns_of(walk):
    for plan, position, role, text in walk:
        if plan is not None:
            conv_id = plan["conv_id"]
        else:
            yield {"conv_id": conv_id, "position": position, "role": role, "text": text}


def _digests_of(walk):
    head, digest = None, None
    for plan, position, role, text in walk:
        if plan is None:
            digest.update(f"{'\n' if position > 1 else ''}{role}:{text}".encode())
            continue
        if head is not None:
            yield head | {"repaired_sha256": digest.hexdigest()}
        head, digest = plan, hashlib.sha256()
    if head is not None:
        yield head | {"repaired_sha256": digest.hexdigest()}


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``conv_id, position, role, text`` of the repaired conversations, ``position`` from 1."""
    kind = planned.schema["conv_id"].dataType.simpleString()
    return _streamed(rows, planned, f"conv_id {kind}, position long, role string, text string", _turns_of)


def repaired_digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``planned`` with ``repaired_sha256`` of the turns as ``role:text``, joined by line ends.

    A digest is of one stream by definition, so a conversation's texts pass through one task; they
    pass through it in sorted batches and are not held.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in planned.schema)
    return _streamed(rows, planned, f"{schema}, repaired_sha256 string", _digests_of)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``plans`` of ``rows`` with digests; one row also for each ``conv_id`` of ``conversations``
    that has no rows: zeros, an empty audit and the digest of nothing."""
    planned = plans(rows)
    if conversations is not None:
        every = conversations.select("conv_id").distinct().alias("every")
        same = F.col("every.conv_id").eqNullSafe(F.col("planned.conv_id"))
        planned = every.join(planned.withColumn("has", F.lit(True)).alias("planned"), same, "left")
        zeros = [
            F.when(F.col("has"), F.col(n)).otherwise(F.lit("" if n == "audit" else 0)).alias(n)
            for n in (f.split()[0] for f in _PLAN.split(", "))
        ]
        planned = planned.select("every.conv_id", *zeros)
        planned = planned.select("conv_id", *[F.col(f.split()[0]).cast(f.split()[1]) for f in _PLAN.split(", ")])
    return repaired_digests(rows, planned)
