"""Cheapest repair of conversations whose turns are broken, by divide and conquer in linear space.

A repaired conversation is empty, or has an optional system turn and then pairs of a user and an assistant turn. While it is read, four
states tell what may come: nothing yet, after the system, after a user, after an assistant turn. Each row is kept, given another
role or deleted, and turns without text may be inserted before it; all that costs. Vectors of four costs, one from the first row
forward and one from the last row backward, meet in the middle row: the state where their sum is least is on a cheapest path, and both
halves are solved alone. No table of all rows times all states is kept.

Of equally cheap edits those come first whose initials come first in ASCII order. Two different ways to different states in the middle
have different initials there, and none begins with the other, as both have treated as many rows and end with a row.
So it is enough to know how the best ways to the four states rank, and the forward vector carries that rank beside the cost.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmetrica.llm.turns import by_conversation, stretches

NEW, SYSTEM, USER, ASSISTANT = range(4)
BEFORE_USER = (NEW, SYSTEM, ASSISTANT)
RELABEL, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
FAR = 1 << 60
TAIL = {NEW: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # what completes a conversation that ends in this state
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, GONE = 3, 16  # initial of any other role; a row that is not there
FINE, TRUNCATED, BLANK, DUPLICATE = 0, 4, 8, 12


def expected(state: int) -> int:
    """The state after the next user or assistant turn."""
    return USER if state in BEFORE_USER else ASSISTANT


@lru_cache(maxsize=None)
def ways(code: int) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, edits)`` for a row: up to two insertions (more never pay), then what happens to the row."""
    initial, fault = code & 3, code & 12
    out = []
    for begin in range(4):
        state = begin
        for times in range(3):
            head, cost = "I" * times, INSERT * times
            out.append((begin, state, cost + DELETE, head + "D"))
            if fault in (FINE, TRUNCATED):
                extra = CUT_SHORT if fault == TRUNCATED else 0
                out.append((begin, expected(state), cost + extra + RELABEL, head + "R"))
                if initial == 0 and state == NEW:
                    out.append((begin, SYSTEM, cost + extra, head + "K"))
                if initial == expected(state) - 1 and initial:
                    out.append((begin, expected(state), cost + extra, head + "K"))
            state = expected(state)
    return out


@lru_cache(maxsize=1 << 16)
def forward(vector: tuple, code: int) -> tuple[tuple, int]:
    """The vector of ``(cost, rank)`` after a row, least cost 0, and what was taken off the costs."""
    best = [None] * 4
    for begin, end, cost, edits in ways(code):
        before, rank = vector[begin]
        if before < FAR:
            found = (before + cost, rank, edits)
            if best[end] is None or found < best[end]:
                best[end] = found
    ranks = {x[1:]: i for i, x in enumerate(sorted((x for x in best if x), key=lambda x: x[1:]))}
    least = min(x[0] for x in best if x)
    return tuple((x[0] - least, ranks[x[1:]]) if x else (FAR, 0) for x in best), least


@lru_cache(maxsize=1 << 16)
def backward(vector: tuple, code: int) -> tuple[tuple, int]:
    """The vector of costs from before a row to the end, least cost 0, and what was taken off."""
    best = [FAR] * 4
    for begin, end, cost, _ in ways(code):
        best[begin] = min(best[begin], cost + vector[end])
    least = min(best)
    return tuple(min(x - least, FAR) if x < FAR else FAR for x in best), least


def only(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in range(4))


def crossing(codes: bytes, start: int, middle: int, end: int, begin: int, last: tuple) -> tuple[int, int]:
    """The state after row ``middle - 1`` of the best way, and the cost of that way; ``last`` are the costs after row ``end - 1``."""
    there, spent = tuple((c, 0) for c in only(begin)), 0
    for code in codes[start:middle]:
        there, cost = forward(there, code)
        spent += cost
    back, left = last, 0
    for i in range(end - 1, middle - 1, -1):
        back, cost = backward(back, codes[i])
        left += cost
    total, _, state = min((a + b, rank, state) for state, ((a, rank), b) in enumerate(zip(there, back, strict=True)))
    return state, total + spent + left


def edits_between(codes: bytes, start: int, end: int, begin: int, finish: int, out: list[str]) -> None:
    """Appends the best edits of the rows that lead from one state to another."""
    if end - start == 1:
        out.append(min((cost, edits) for a, b, cost, edits in ways(codes[start]) if a == begin and b == finish)[1])
        return
    middle = (start + end) // 2
    state, _ = crossing(codes, start, middle, end, begin, only(finish))
    edits_between(codes, start, middle, begin, state, out)
    edits_between(codes, middle, end, state, finish, out)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and initials of the best edits of a conversation, a code for each row."""
    tail = tuple(INSERT * len(TAIL[s]) for s in range(4))
    if not codes:
        return 0, ""
    finish, cost = crossing(codes, 0, len(codes), len(codes), NEW, tail)
    out: list[str] = []
    edits_between(codes, 0, len(codes), NEW, finish, out)
    return cost, "".join(out) + TAIL[finish]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, gone, place..)``: rows after the damage that a CRC of ``conv:turn`` picks; ``place`` columns order a conversation.

    Of 20 equally likely values 0 drops the row (``gone``), 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes it
    a user's. NULL roles and texts become one space, and so do NULLs in the CRC's string. Rows of one turn stand in order of role and text hash.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    spoilt = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("said", "[.!?]", "")).otherwise(F.col("said"))
    read = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("place_role"), blank(text).alias("said"), fate.alias("fate"))
    read = read.withColumn("place_text", F.sha2("said", 256))
    read = read.select(
        "conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("place_role")).alias("role"), spoilt.alias("text"),
        (F.col("fate") == 0).alias("gone"), "place_role", "place_text", F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"),
    )
    return read.withColumn("place_copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


ORDER = ["place_role", "place_text", "place_copy"]


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), *[F.col(c) for c in ORDER]]


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` without texts, with ``code``: the initial of the role and the first fault of the row.

    Blank: no character but ASCII white space. Duplicate: an earlier row of the conversation has this role and text.
    Truncated: the last character that isn't white space is none of ``.!?``.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    seen = rows.select(
        "conv", "turn", *ORDER, "gone", F.sha2("role", 256).alias("role"), F.sha2("text", 256).alias("text"),
        kind.alias("kind"), F.when(blank, BLANK).when(whole, FINE).otherwise(TRUNCATED).alias("fault"),
    )
    # The window's partitions lie inside those of the conversations, so there is one exchange.
    seen = seen.repartition("conv")
    earlier = F.row_number().over(Window.partitionBy("conv", "gone", "role", "text").orderBy(*in_order())) > 1
    fault = F.when((F.col("fault") != BLANK) & F.col("earlier"), DUPLICATE).otherwise(F.col("fault"))
    code = F.when(F.col("gone"), GONE).otherwise(F.col("kind") + fault)
    return seen.withColumn("earlier", earlier).select("conv", "turn", *ORDER, code.alias("code"))


REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NAMES = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
LEGAL = {(0, 1), (1, 2), (2, 1)}


class Found:
    """What is known of the conversation that is being read: a byte for each row, and its turns' range."""

    def __init__(self, conv: int | None):
        self.conv, self.codes, self.turns, self.first, self.last = conv, bytearray(), 0, None, None

    def add(self, rows: pa.RecordBatch) -> None:
        for turn, code in zip(rows.column("turn").to_pylist(), rows.column("code").to_pylist(), strict=True):
            if code == GONE:
                continue
            self.codes.append(code)
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last = turn
                self.turns += 1

    def report(self) -> tuple:
        codes = bytes(self.codes)
        fault = [sum(codes.count(f + k) for k in range(4)) for f in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *fault, illegal, *cheapest(codes))


def repairs(rows: DataFrame) -> DataFrame:
    """A report for every conversation of ``rows``, as :func:`damaged` returns them: faults, cost and initials of the cheapest edits.

    Conversations are read as streams; one byte a row is held, so a conversation may be longer than memory for its texts.
    """

    def run(batches):
        now, done = None, []
        for conv, begins, part in stretches(batches):
            if begins:
                if now is not None:
                    done.append(now.report())
                now = Found(conv)
            now.add(part)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, d, strict=True)) for d in done], SCHEMA)
                done = []
        if now is not None:
            done.append(now.report())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, d, strict=True)) for d in done], SCHEMA)

    coded = faults(rows)
    return coded.sortWithinPartitions(F.col("conv").asc_nulls_first(), *in_order(), "code").mapInArrow(run, REPORT)


SCHEMA = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in NAMES])


class Edited:
    """Applies the initials of a conversation's edits to its rows, one after the other."""

    def __init__(self, conv: int | None, audit: str):
        self.conv, self.audit, self.at, self.state = conv, audit, 0, NEW

    def step(self, role: str = "", text: str = ""):
        """The next turns: insertions, and the row itself if it stays, as ``(edit, role, text)``."""
        while self.at < len(self.audit):
            edit = self.audit[self.at]
            self.at += 1
            if edit == "D":
                return
            if edit == "K":
                self.state = SYSTEM if role[0] == "s" else expected(self.state)
                yield edit, role, text
                return
            self.state = expected(self.state)
            name = "user" if self.state == USER else "assistant"
            yield edit, name, "" if edit == "I" else text
            if edit == "R":
                return


def edit_stream(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Rows that are there, behind the report of their conversation, in order."""
    first = reports.select("conv", F.lit(0).alias("kind"), *[F.col(c) for c in NAMES[1:]])
    there = rows.where("NOT gone").select("conv", F.lit(1).alias("kind"), "turn", *ORDER, "role", "text")
    return by_conversation(first.unionByName(there, allowMissingColumns=True), "kind", *in_order())


def edits(batches):
    """``(conversation's edits, report row or None, turns)`` for each row of a stream; turns left at the end come with the next report."""
    now = None
    for conv, _, part in stretches(batches):
        kinds, roles, said = (part.column(c).to_pylist() for c in ("kind", "role", "text"))
        for i, kind in enumerate(kinds):
            if kind == 0:
                if now is not None:
                    yield now, None, now.step()
                report = part.slice(i, 1).select(NAMES).to_pylist()[0]
                now = Edited(conv, report["audit"])
                yield now, report, ()
            else:
                yield now, None, now.step(roles[i], said[i])
    if now is not None:
        yield now, None, now.step()


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired conversations: ``(conv, place, edit, role, text)``, ``place`` from 0 in each."""

    def run(batches):
        fields = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out, size, place = [], 0, 0
        for now, report, turns in edits(batches):
            place = 0 if report else place
            for edit, role, text in turns:
                out.append({"conv": now.conv, "place": place, "edit": edit, "role": role, "text": text})
                place, size = place + 1, size + len(text)
            if size > 4 << 20 or len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, fields)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)

    return edit_stream(rows, reports).mapInArrow(run, "conv long, place long, edit string, role string, text string")


def repaired_digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` with ``repaired_sha256``: of ``role:text`` of the repaired turns, joined by line ends. Texts are read as a stream."""

    def run(batches):
        fields = SCHEMA.append(pa.field("repaired_sha256", pa.string()))
        out, row, digest, head = [], None, None, b""
        for _, report, turns in edits(batches):
            if report:
                if row:
                    out.append(row | {"repaired_sha256": digest.hexdigest()})
                row, digest, head = report, sha256(), b""
            for _, role, text in turns:
                digest.update(head + f"{role}:{text}".encode())
                head = b"\n"
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, fields)
                out = []
        if row:
            out.append(row | {"repaired_sha256": digest.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)

    return edit_stream(rows, reports).mapInArrow(run, REPORT + ", repaired_sha256 string")
