"""Token ids of whole texts with a public tokenizer, through a bounded cache of words.

The byte-level pre-tokenizer starts a new piece at every single space or line end
between two other characters, so the pieces between those cuts are encoded on their own
and their ids are kept; natural text repeats most of its words. A text
where white space meets white space or an end is cut only at the spaces that are safe.

Whole columns of text are cut on their bytes instead, also between letters, digits and marks that one byte or two tell apart, and their pieces are
looked up in a bounded table of columns.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]  # white space other than the two cut at
SAFE = re.compile(r"(?<=\S) (?=\S)")
KEPT = 250_000  # pieces in each of the two generations of the cache
PART_BYTES = 8 << 20  # text whose pieces are looked up together
KNOWN, KNOWN_BYTES = 500_000, 64  # pieces in the table of known ones, and the longest that are kept there
FIRST_BYTE = np.zeros(256, np.uint8)  # 1: white space of one byte; otherwise the bytes of white space that may begin so
for _c in [*SPACES, " ", "\n"]:
    FIRST_BYTE[_c.encode()[0]] = len(_c.encode())
WIDE = {n: np.array([int.from_bytes(c.encode(), "big") for c in SPACES if len(c.encode()) == n]) for n in (2, 3)}
LETTER, DIGIT, MARK, QUOTE = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)  # 0: not told by the first byte
for _b in range(128):
    KIND[_b] = LETTER if chr(_b).isalpha() else DIGIT if chr(_b).isdigit() else QUOTE if _b == 39 else MARK if 33 <= _b <= 126 else 0
TWO_BYTES = [*range(0xC3, 0xCA), 0xD0, 0xD1]  # Latin and Cyrillic; all are letters but the signs of times and division
KIND[TWO_BYTES] = LETTER
CUT = np.zeros((5, 5), bool)  # kinds that are never in one pre-token, one before the other; a quote is with what follows it
CUT[1:4, 1:4] = ~np.eye(3, dtype=bool)
CUT[[LETTER, DIGIT], QUOTE] = True


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of character that each byte of UTF-8 belongs to, 0 where it is not looked up."""
    kind = KIND[data]
    at = np.flatnonzero((kind[:-1] == LETTER) & (data[:-1] >= 128))
    sign = (data[at] == 0xC3) & ((data[at + 1] == 0x97) | (data[at + 1] == 0xB7))
    kind[at[sign]] = 0
    kind[at[~sign] + 1] = LETTER
    return kind


def white_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are white space or parts of it."""
    first = FIRST_BYTE[data]
    white = first == 1
    for n, known in WIDE.items():
        at = np.flatnonzero(first[: max(0, len(data) - n + 1)] == n)
        code = np.zeros(len(at), np.int64)
        for k in range(n):
            code = code << 8 | data[at + k]
        at = at[np.isin(code, known)]
        for k in range(n):
            white[at + k] = True
    return white


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which bytes begin a piece: texts, single spaces and single line ends between two other characters, what follows these line ends, and changes of kind."""
    begins, edge = np.zeros(len(data), bool), np.zeros(len(data), bool)
    kind = kinds(data)
    begins[1:] = CUT.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]
    full = bounds[1:] > bounds[:-1]
    begins[bounds[:-1][full]] = edge[bounds[:-1][full]] = edge[bounds[1:][full] - 1] = True
    at = np.flatnonzero(((data == 32) | (data == 10)) & ~edge)
    white = white_bytes(data)
    at = at[~(white[at - 1] | white[at + 1])]
    begins[at] = True
    begins[at[data[at] == 10] + 1] = True
    return begins


MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~\"\\"


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies spell the 256 bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


LETTERS = byte_letters()


class Pieces(dict):
    """Ids of pieces (words with the space before them, if any): made where they are first met, kept while they are in use."""

    def __init__(self, tokenizer, space: str):
        super().__init__()
        self.space, self.model, self.cut = space, tokenizer.model, tokenizer.pre_tokenizer
        self.lead = LETTERS[32] if space else ""
        self.marks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.number = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def spell(self, word: str) -> bytes:
        return b"".join([self.number[t.id] for t in self.model.tokenize(word)])

    def make(self, piece: str) -> bytes:
        if piece.isalpha():  # letters are one pre-token
            return self.spell(self.lead + (piece if piece.isascii() else "".join([LETTERS[b] for b in piece.encode()])))
        core = piece.rstrip(MARKS)
        if core.isalpha():  # letters and marks are two
            marks = piece[len(core) :]
            if marks not in self.marks:
                self.marks[marks] = self.spell(marks)
            return self[core] + self.marks[marks]
        return b"".join([self.spell(p) for p, _ in self.cut.pre_tokenize_str(self.space + piece)])

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        self[piece] = got
        return got

    def turn(self) -> None:
        """Between texts: starts a new generation when this one is full."""
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()
        if len(self.marks) > KEPT:
            self.marks = {}


class Known:
    """Pieces met before, as columns: their bytes, their ids one after another, and when each was last met. Those met longest ago go first."""

    def __init__(self):
        self.names, self.flat = pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.size, self.met, self.now = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def look_up(self, pieces: pa.Array, spell: Callable[[pa.Array], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece where its ids begin and how many they are, and the ids; ``spell`` makes those of pieces not met before."""
        found = pa.compute.index_in(pieces, value_set=self.names)
        missing = found.is_null()
        new = pieces.filter(missing).dictionary_encode()
        number, missing = found.fill_null(0).to_numpy().astype(np.int64), missing.to_numpy(zero_copy_only=False)
        number[missing] = new.indices.to_numpy() + len(self.names)
        made = spell(new.dictionary)
        self.names = pa.concat_arrays([self.names, new.dictionary])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), "<u4")])
        self.size = np.append(self.size, np.array([len(x) // 4 for x in made], np.int64))
        self.now += 1
        self.met = np.append(self.met, np.zeros(len(made), np.int64))
        self.met[number] = self.now
        out = (np.cumsum(self.size) - self.size)[number], self.size[number], self.flat
        self.forget()
        return out

    def forget(self) -> None:
        keep = pa.compute.binary_length(self.names).to_numpy() <= KNOWN_BYTES
        if keep.sum() > KNOWN:
            keep &= self.met >= np.partition(self.met[keep], -KNOWN // 2)[-KNOWN // 2]
            if keep.sum() > KNOWN:  # all at once
                keep[np.flatnonzero(keep)[KNOWN:]] = False
        if not keep.all():
            self.flat = self.flat[np.repeat(keep, self.size)]
            self.names, self.size, self.met = self.names.filter(pa.array(keep)), self.size[keep], self.met[keep]


class Encoder:
    """``encode`` turns texts into ids as little-endian unsigned 32-bit integers, ``encode_column`` a column of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has put a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.heads, self.tails = Pieces(self.tokenizer, ""), Pieces(self.tokenizer, " ")
        self.known = Known()
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        lines = [line.split(" ") for line in text.split("\n")]
        if any("" in line for line in lines) or any(c in text for c in SPACES):
            lines = [SAFE.split(text)]
        head, tail = self.heads, self.tails.__getitem__
        return self.line.join([head[x[0]] + b"".join(map(tail, x[1:])) for x in lines])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            self.heads.turn()
            self.tails.turn()
            out.append(self.one(text))
        return out

    def spelled(self, pieces: pa.Array, odd: set[bytes]) -> list[bytes]:
        """Ids of pieces; those in ``odd`` are texts with special tokens."""
        head, tail, line = self.heads, self.tails, self.line
        head.turn()
        tail.turn()
        words = pieces.cast(pa.string()).to_pylist()
        if odd:
            return [self.whole(p) if p.encode() in odd else tail.make(p[1:]) if p[0] == " " else head.make(p) for p in words]
        return [tail.make(p[1:]) if p[0] == " " else line if p == "\n" else head.make(p) for p in words]

    def encode_column(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts one after another, each with ``end_id`` behind it, and how many each text has, by parts of the column.

        The pieces of a part are cut, looked up and put together as columns.
        """
        if not len(texts):
            return
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, places, data = texts.buffers()
        bounds = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        part = (bounds[:-1] - bounds[0]) // PART_BYTES
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for first, last in zip([0, *ends[:-1]], ends, strict=True):
            own = bounds[first : last + 1]
            yield self.encode_bytes(data[own[0] : own[-1]], own - own[0], end_id)

    def encode_bytes(self, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        begins, held = piece_starts(data, bounds), data.tobytes()
        odd = set()  # texts with special tokens, which stay whole
        for special in map(str.encode, self.special):
            at = held.find(special)
            while at >= 0:
                text = int(np.searchsorted(bounds, at, side="right")) - 1
                begins[bounds[text] + 1 : bounds[text + 1]] = False
                odd.add(held[bounds[text] : bounds[text + 1]])
                at = held.find(special, max(at + 1, int(bounds[text + 1])))
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
        place, size, flat = self.known.look_up(pieces, lambda new: self.spelled(new, odd))
        behind = np.searchsorted(starts, bounds)  # pieces before each text
        place, size = np.insert(place, behind[1:], len(flat)), np.insert(size, behind[1:], 1)
        upto = np.cumsum(size)
        out = np.append(flat, np.uint32(end_id))[np.repeat(place - upto + size, size) + np.arange(upto[-1])]
        return out, np.diff(np.append(0, upto)[behind + np.arange(len(behind))])


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def token_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file; looked up where it is used, as machines may differ."""
    import public_tokenizers

    return public_tokenizers.path(name)
