"""Conversations as token sequences with a loss mask, assembled from separately encoded segments.

A conversation begins with ``<s>``. A user's turn is ``[INST]`` text ``[/INST]``, an assistant's is text ``</s>``, a system's is ``[SYS]`` text
``[/SYS]``; a turn of any other role is ``[ROLE]`` role ``[SAYS]`` text ``[/ROLE]``. These control strings are ids of their own behind the
vocabulary, spliced between the ids of the texts, so no text can give them. In the written form of a sequence a text might spell one, so a
backslash is put behind its first character, and one more where there are some already; that is undone by taking one
away. The loss covers the assistants' texts and the ``</s>`` behind each.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmetrica.llm.common import per_batch
from sparkmetrica.llm.tokens import LETTERS, encoder, token_path
from sparkmetrica.llm.turns import by_conversation, stretches

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[SAYS]", "[/ROLE]"]
#: What surrounds a text, by role; any other role has the last one.
USER, ASSISTANT, SYSTEM, OTHER = range(4)
ROLES = {"user": USER, "assistant": ASSISTANT, "system": SYSTEM}
FRAME_TOKENS = 1 << 20


class Template:
    """The control strings of a tokenizer: their ids, and how texts are escaped and restored."""

    def __init__(self, path: str):
        self.code = encoder(path)
        size = self.code.tokenizer.get_vocab_size()
        self.ids = {name: size + i for i, name in enumerate(CONTROLS)}
        self.names = {i: name for name, i in self.ids.items()}
        self.size = size
        spelt = [*CONTROLS, *self.code.special]  # the tokenizer's own special strings would be read as their ids
        rest = "|".join(re.escape(s[1:]) for s in spelt)
        first = "[" + re.escape("".join(sorted({s[0] for s in spelt}))) + "]"
        self.plain = re.compile(rf"({first})(\\*)(?={rest})")
        self.marked = re.compile(rf"({first})\\(\\*)(?={rest})")
        back = {letter: byte for byte, letter in LETTERS.items()}
        self.bytes = [b""] * size
        for token, i in self.code.tokenizer.get_vocab().items():
            if all(c in back for c in token):
                self.bytes[i] = bytes(back[c] for c in token)
        for i, token in self.code.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = token.content.encode()

    def escape(self, text: str) -> str:
        return self.plain.sub(r"\1\\\2", text)

    def restore(self, text: str) -> str:
        return self.marked.sub(r"\1\2", text)

    def segment(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.code.one(self.escape(text or ""))

    def decode(self, ids: np.ndarray) -> str:
        """The escaped text of ordinary ids."""
        return b"".join([self.bytes[i] for i in ids.tolist()]).decode()

    def around(self, role: int) -> tuple[list[str], list[str]]:
        """Control strings before and behind a text."""
        return (([], ["</s>"]) if role == ASSISTANT else (["[INST]"], ["[/INST]"]) if role == USER else (["[SYS]"], ["[/SYS]"]) if role == SYSTEM else (["[ROLE]"], ["[/ROLE]"]))

    def turn(self, role: int, name: bytes, text: bytes) -> tuple[np.ndarray, int, int]:
        """The ids of a turn and where loss begins and ends in it."""
        before, behind = ([self.ids[c] for c in cs] for cs in self.around(role))
        parts = [np.array(before, np.uint32)]
        if role == OTHER:
            parts += [np.frombuffer(name, "<u4"), np.array([self.ids["[SAYS]"]], np.uint32)]
        parts += [np.frombuffer(text, "<u4"), np.array(behind, np.uint32)]
        ids = np.concatenate(parts)
        return ids, 0, len(ids) if role == ASSISTANT else 0

    def turns(self, ids: np.ndarray):
        """Reads whole turns back: ``(role, text, positions of the text, code points written)``; ``<s>`` before them is skipped."""
        at = np.flatnonzero(ids >= self.size)
        begin, role, name, chars = 0, ASSISTANT, "assistant", 0
        for place in at.tolist():
            control = self.names[int(ids[place])]
            chars += len(control)
            if control in ("</s>", "[/INST]", "[/SYS]", "[/ROLE]"):
                written = self.decode(ids[begin:place])
                yield name, self.restore(written), (begin, place), chars + len(written)
                name, chars = "assistant", 0
            elif control == "[SAYS]":
                written = self.decode(ids[begin:place])
                name, chars = self.restore(written), chars + len(written)
            else:
                name = {"[INST]": "user", "[SYS]": "system"}.get(control, "assistant")
            begin = place + 1


TEMPLATES: dict[str, Template] = {}


def template(path: str | None) -> Template:
    """The template of this worker process."""
    path = path or token_path()
    if path not in TEMPLATES:
        TEMPLATES[path] = Template(path)
    return TEMPLATES[path]


FRAME = "conv long, frame long, last boolean, n_turns long, ids binary, mask binary"


class Assembly:
    """The frame that is being filled: ids of whole turns, and where the loss changes."""

    def __init__(self, conv: int | None, number: int, start: list[int]):
        self.conv, self.number, self.turns = conv, number, 0
        self.parts, self.size = [np.array(start, np.uint32)], len(start)
        self.changes: list[tuple[int, int]] = []

    def add(self, ids: np.ndarray, begin: int, end: int) -> None:
        self.changes += [(self.size + begin, 1), (self.size + end, -1)]
        self.parts.append(ids)
        self.size += len(ids)
        self.turns += 1

    def row(self, last: bool) -> dict:
        ids = np.concatenate(self.parts).astype("<u4")
        step = np.zeros(len(ids) + 1, np.int64)
        for place, change in self.changes:
            step[place] += change
        mask = np.cumsum(step)[:-1].astype(np.uint8)
        return {"conv": self.conv, "frame": self.number, "last": last, "n_turns": self.turns, "ids": ids.tobytes(), "mask": mask.tobytes()}


FIELDS = pa.schema([("conv", pa.int64()), ("frame", pa.int64()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("ids", pa.binary()), ("mask", pa.binary())])


def assemble(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", path: str | None = None, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """``(conv, frame, last, n_turns, ids, mask)``: ids as little-endian unsigned 32-bit integers, a mask byte for each.

    Turns of a conversation stand in order (NULL first; of one turn by role, then ids). NULL texts and roles are empty, a NULL
    conversation is one. A conversation of more than ``frame_tokens`` has several frames, cut between turns.
    Segments are encoded where their rows are; only ids of 16 bits go through the exchange.
    """

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = template(path)
        made.code.heads.turn()
        made.code.tails.turn()
        kind = np.uint16 if made.size <= 1 << 16 else np.uint32
        small = lambda x: np.frombuffer(x, "<u4").astype(kind).tobytes()
        roles = [r or "" for r in batch.column("role").to_pylist()]
        names = [b"" if r in ROLES else small(made.segment(r)) for r in roles]
        texts = [small(made.segment(t)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(names, pa.binary()), pa.array(texts, pa.binary())],
            ["conv", "turn", "role", "name", "ids"],
        )

    def splice(batches):
        made = template(path)
        kind = np.uint16 if made.size <= 1 << 16 else np.uint32
        wide = lambda x: np.frombuffer(x, kind).astype("<u4").tobytes()
        now, out, held = None, [], 0
        for key, begins, part in stretches(batches):
            if begins:
                if now is not None:
                    out.append(now.row(True))
                now = Assembly(key, 0, [made.ids["<s>"]])
            for r, name, ids in zip(part.column("role").to_pylist(), part.column("name").to_pylist(), part.column("ids").to_pylist(), strict=True):
                if now.size >= frame_tokens:
                    out.append(now.row(False))
                    now = Assembly(key, now.number + 1, [])
                now.add(*made.turn(ROLES.get(r, OTHER), wide(name), wide(ids)))
                held += len(ids)
                if held > 1 << 20 and out:
                    yield pa.RecordBatch.from_pylist(out, FIELDS)
                    out, held = [], 0
        if now is not None:
            out.append(now.row(True))
        if out:
            yield pa.RecordBatch.from_pylist(out, FIELDS)

    read = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    encoded = read.mapInArrow(per_batch(encode), "conv long, turn long, role string, name binary, ids binary")
    return by_conversation(encoded, F.col("turn").asc_nulls_first(), "role", "ids").mapInArrow(splice, FRAME)


DIGEST = "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(frames: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation, from its frames alone: turns and their hash, the text under the loss and its hash, code points of the written form."""
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    fields = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in names])

    def run(batches):
        made = template(path)
        out, row, turns, loss = [], None, None, None

        def close():
            out.append(row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})

        for key, begins, part in stretches(batches):
            for i, (ids, mask) in enumerate(zip(part.column("ids").to_pylist(), part.column("mask").to_pylist(), strict=True)):
                if begins and i == 0:
                    if row:
                        close()
                    row, turns, loss = {"conv": key, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}, sha256(), sha256()
                weight = np.frombuffer(mask, np.uint8)
                for role, text, (start, end), chars in made.turns(np.frombuffer(ids, "<u4")):
                    row["n_turns"] += 1
                    row["formatted_chars"] += chars
                    turns.update(f"{role}\n{text}\n".encode())
                    if weight[start:end].any():
                        assert weight[start:end].all()
                        row["loss_chars"] += len(text)
                        loss.update(text.encode())
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out.clear()
        if row:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, fields)

    whole = F.col("last") & (F.col("frame") == 0)
    short = frames.where(whole).mapInArrow(run, DIGEST)  # one frame each, read where it lies
    return short.union(by_conversation(frames.where(~whole), "frame").mapInArrow(run, DIGEST))
