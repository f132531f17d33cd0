"""Chat formatting and conversation repair against brute force, on tables with every odd case."""

import re
from hashlib import sha256
from itertools import product
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmetrica.llm import chat, repair, turns
from sparkmetrica.llm.queries import TRICK
from sparkmetrica.session import settle

SCHEMA = "conv_id long, turn long, role string, text string, conv string, gone string, kind string, ids string"


def odd_rows():
    rng = np.random.default_rng(3)
    texts = ["Hello there.", "What?", "I can't say", "", " \t\n", None, TRICK, "a <|endoftext|> b.", "[\\\\INST] <\\s> [SAYS]x", "é 漢字!", "End.\n \x0b", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "[SAYS]", "User"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(int(rng.integers(1, 14))):
            role = str(rng.choice(["user", "assistant"])) if rng.random() < 0.75 else roles[int(rng.integers(len(roles)))]
            text = f"Line {turn} of {conv}." if rng.random() < 0.5 else texts[int(rng.integers(len(texts)))]
            at = None if rng.random() < 0.05 else turn + int(rng.integers(0, 2)) * 3
            rows.append((conv, at, role, text))
    rows += [(7, 2, "user", "Twice."), (7, 2, "user", "Twice."), (-5, None, "assistant", "Alone"), (2**53 + 1, 2**40, "system", "Only a system.")]
    rows += [(900, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}." if i % 5 else f"turn {i}") for i in range(700)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "g", "k", "i") for r in rows], SCHEMA).repartition(5).cache()


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("frame_tokens", [chat.FRAME_TOKENS, 40])
def test_chat_reads_back_what_was_written(spark, rows, table, frame_tokens):
    frames = settle(chat.assemble(table, frame_tokens=frame_tokens))
    got = {r.conv: r for r in chat.read_back(frames).collect()}
    groups = by_conversation(rows)
    assert set(got) == set(groups)
    made = chat.template(None)
    code = made.code.tokenizer
    for conv, own in groups.items():
        read = [(r[1], r[2] or "", r[3] or "") for r in own]
        read.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), np.array(code.encode(made.escape(r[2])).ids, np.uint16).tobytes()))
        said = "".join(t for _, r, t in read if r == "assistant")
        one = got[conv]
        assert one.n_turns == len(read)
        assert one.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for _, r, t in read).encode()).hexdigest()
        assert (one.loss_chars, one.loss_sha256) == (len(said), sha256(said.encode()).hexdigest())
        marks = {"user": 13, "assistant": 4, "system": 11}
        assert one.formatted_chars == 3 + sum(len(made.escape(t)) + marks.get(r, 19 + len(made.escape(r))) for _, r, t in read)
    if frame_tokens == 40:
        assert frames.where("conv = 900").count() > 50
        assert frames.groupBy("conv").agg(F.count_if("last").alias("n")).where("n <> 1").count() == 0


def test_ids_are_those_of_the_library_between_the_control_ids(table):
    made = chat.template(None)
    own = made.code.tokenizer
    frames = chat.assemble(table.where("conv_id = 900")).collect()
    ids, mask = (np.concatenate([np.frombuffer(f[c], t) for f in sorted(frames, key=lambda f: f.frame)]) for c, t in (("ids", "<u4"), ("mask", np.uint8)))
    want, loss = [made.ids["<s>"]], [0]
    for i in range(700):
        text = own.encode(f"Turn {i}." if i % 5 else f"turn {i}").ids
        turn = [made.ids["[INST]"], *text, made.ids["[/INST]"]] if i % 2 == 0 else [*text, made.ids["</s>"]]
        want += turn
        loss += [i % 2] * len(turn)
    assert ids.tolist() == want and mask.tolist() == loss


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "<|endoftext|>", "<", "[", "\\", "\\\\", "s>", "/s>", "INST]", "/", "SYS]", "|endoftext|>", "a", " "]), max_size=12))
def test_escapes_are_undone_and_leave_no_control_string(parts):
    made, text = chat.template(None), "".join(parts)
    written = made.escape(text)
    assert made.restore(written) == text
    assert not any(c in written for c in [*chat.CONTROLS, "<|endoftext|>"])
    assert made.decode(np.frombuffer(made.segment(text), "<u4")) == written


def test_no_conversation_gives_nothing(spark, table):
    none = table.where("false")
    assert chat.read_back(chat.assemble(none)).count() == 0
    found = repair.damaged(none)
    assert repair.repaired_digests(found, repair.repairs(found)).count() == 0


def best_edits(codes):
    """Dynamic programming over whole strings: least cost, then least initials."""
    best = {repair.NEW: (0, "")}
    for code in codes:
        after = {}
        for state, (cost, audit) in best.items():
            for begin, end, more, edits in repair.ways(code):
                if begin == state:
                    after[end] = min(after.get(end, (10**9, "")), (cost + more, audit + edits))
        best = after
    return min((c + 5 * len(repair.TAIL[s]), a + repair.TAIL[s]) for s, (c, a) in best.items())


CODES = [k + f for k in range(4) for f in (0, 4, 8, 12)]


def test_repair_is_cheapest_and_first_in_ascii_order():
    rng = np.random.default_rng(8)
    for n in [0, 1, 2, 3, 5, 9, 17, 40, 64, 129]:
        for _ in range(60):
            codes = bytes(rng.choice(CODES, n, p=[0.15, 0.25, 0.25, 0.07, *[0.28 / 12] * 12][:16]).tolist()) if n else b""
            assert repair.cheapest(codes) == best_edits(codes)
    codes = bytes(rng.choice(CODES, 50_000).tolist())
    assert repair.cheapest(codes) == best_edits_long(codes)


def best_edits_long(codes):
    """The same from the end: costs to go, then the first edits that keep to them."""
    costs = [{s: 5 * len(repair.TAIL[s]) for s in range(4)}]
    for code in reversed(codes):
        costs.append({s: min(c + costs[-1][e] for b, e, c, _ in repair.ways(code) if b == s) for s in range(4)})
    costs.reverse()
    state, audit = repair.NEW, []
    for i, code in enumerate(codes):
        edits, state = min((w, e) for b, e, c, w in repair.ways(code) if b == state and c + costs[i + 1][e] == costs[i][state])
        audit.append(edits)
    return costs[0][repair.NEW], "".join(audit) + repair.TAIL[state]


def test_ways_reach_all_short_repairs():
    """Every string of edits on one row, tried by the rules themselves."""
    for initial, fault in product(range(4), (0, 4, 8, 12)):
        best = {}
        for word in ("".join(w) + last for k in range(4) for w in product("I", repeat=k) for last in "DKR"):
            for targets in product("ua", repeat=len(word)):
                turns_made, cost = "", 0
                for edit, target in zip(word, targets, strict=True):
                    truncated = fault == 4 and edit in "KR"
                    cost += {"I": 5, "D": 2, "K": 0, "R": 1}[edit] + (5 if truncated else 0)
                    turns_made += "" if edit == "D" else "sua?"[initial] if edit == "K" else target
                if fault in (8, 12) and word[-1] != "D" or not re.fullmatch("(s?(ua)*u?)", turns_made):
                    continue
                state = repair.NEW if not turns_made else {"s": 1, "u": 2, "a": 3}[turns_made[-1]]
                best[state] = min(best.get(state, (99, "")), (cost, word))
        own = {}
        for begin, end, cost, edits in repair.ways(initial + fault):
            if begin == repair.NEW:
                own[end] = min(own.get(end, (99, "")), (cost, edits))
        assert own == best


BLANKS = " \t\n\x0b\x0c\r"


def expected_report(conv, own):
    present, order = [], []
    for _, turn, role, text in own:
        r, t = " " if role is None else role, " " if text is None else text
        fate = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        said = "" if fate == 1 else re.sub("[.!?]", "", t) if fate == 2 else t
        key = (turn is not None, turn or 0, r.encode(), sha256(t.encode()).hexdigest())
        order += [(*key, copy, turn, "user" if fate == 4 else r, said) for copy in range(2 if fate == 3 else 1)]
    present = [x[5:] for x in sorted(order, key=lambda x: x[:5])]
    seen, codes = set(), []
    for _, role, text in present:
        bare = text.strip(BLANKS)
        fault = 8 if not bare else 12 if (role, text) in seen else 0 if bare[-1] in ".!?" else 4
        seen.add((role, text))
        codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + fault)
    cost, audit = best_edits(codes)
    at, state, out = 0, "", []
    for edit in audit:
        row = present[at] if edit != "I" else (None, "", "")
        at += edit != "I"
        if edit == "D":
            continue
        need = "a" if state == "u" else "u"
        state = row[1][0] if edit == "K" else need
        out.append(f"{row[1] if edit == 'K' else {'u': 'user', 'a': 'assistant'}[need]}:{row[2]}")
    known = [t for t, _, _ in present if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(present, present[1:], strict=False))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    faults = [sum(c & 12 == f for c in codes) for f in (8, 12, 4)]
    return (conv, gaps, *faults, illegal, cost, audit, sha256("\n".join(out).encode()).hexdigest()), out


def test_repair_of_a_table_against_brute_force(rows, table):
    found = repair.damaged(table)
    reports = settle(repair.repairs(found))
    want = {conv: expected_report(conv, own) for conv, own in by_conversation(rows).items()}
    digests = repair.repaired_digests(found, reports).collect()
    assert {r.conv: tuple(r) for r in digests} == {c: w for c, (w, _) in want.items()} and len(digests) == len(want)
    kept = {}
    for r in sorted(repair.repaired(found, reports).collect(), key=lambda r: r.place):
        kept.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert kept == {c: out for c, (_, out) in want.items() if out}
    assert any(not w[-2] for w, _ in want.values())  # a conversation that lost all rows


def test_streams_cut_conversations_over_batches(spark):
    import pyarrow as pa

    ids = [None, None, 0, 0, 0, 5, 5]
    batches = [pa.RecordBatch.from_pydict({"conv": pa.array(ids[a:b], pa.int64())}) for a, b in ((0, 1), (1, 3), (3, 3), (3, 6), (6, 7))]
    got = [(k, new, part.num_rows) for k, new, part in turns.stretches(batches)]
    assert got == [(None, True, 1), (None, False, 1), (0, True, 1), (0, False, 2), (5, True, 1), (5, False, 1)]
