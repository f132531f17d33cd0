"""Token shards as wavelet matrices: one compressed file per shard that answers queries.

A shard is a block of documents in id order. Its token ids are replaced by their rank of frequency in the shard, and the bits
of these codes are kept plane by plane, each plane stably parted by the plane above (zeros first). With counts of ones every
512 bits a plane answers rank and select, and the planes together give the token at any position, the occurrences
of a token in any range, and the place of each occurrence, without decoding the rest. Files are Parquet, one row per shard,
compressed by zstd.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmetrica.llm.blocks import Blocks, ordered
from sparkmetrica.llm.tokens import encoder, token_path

MAGIC = b"WMX1"
SHARD_BYTES = 8 << 20  # text in a shard
STEP = 512  # bits between counts
SHARD = "shard long, n_docs long, n_tokens long, data binary"


def planes_of(codes: np.ndarray, planes: int):
    """Bits and zeros of each plane, highest first."""
    for p in range(planes - 1, -1, -1):
        bit = (codes >> p) & 1 == 1
        yield bit, len(bit) - int(bit.sum())
        codes = np.concatenate([codes.take(np.flatnonzero(~bit)), codes.take(np.flatnonzero(bit))])  # faster than masks where bits are mixed


def encode(docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """File of a shard: header, documents, alphabet by falling frequency, then zeros, bits and counts of each plane."""
    count = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.argsort(-count, kind="stable")[: int((count > 0).sum())].astype("<u4")
    rank = np.zeros(len(count), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)  # small codes move faster
    rank[alphabet] = np.arange(len(alphabet))
    planes = max(1, int(len(alphabet) - 1).bit_length())
    out = [MAGIC, struct.pack("<4Q", len(docs), len(ids), len(alphabet), planes)]
    out += [np.array([d is None for d in docs], np.uint8).tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), sizes.astype("<u8").tobytes(), alphabet.tobytes()]
    for bit, zeros in planes_of(rank[ids], planes):
        packed = np.packbits(bit, bitorder="little")
        packed = np.pad(packed, (0, -len(packed) % (STEP // 8)))
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1)
        before = np.r_[0, np.cumsum(ones)].astype("<u4")
        out += [struct.pack("<Q", zeros), packed.tobytes(), before.tobytes()]
    return b"".join(out)


class Shard:
    """A shard read from its file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        n_docs, self.n, size, planes = struct.unpack_from("<4Q", data, 4)
        at = 36

        def take(kind, n):
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        null, docs = take(np.uint8, n_docs), take("<i8", n_docs)
        self.docs = [None if z else d for z, d in zip(null.tolist(), docs.tolist(), strict=True)]
        self.sizes = take("<u8", n_docs).astype(np.int64)
        self.alphabet = take("<u4", size)
        self.planes = []
        blocks = -(-self.n // STEP)
        for _ in range(planes):
            zeros = int(take("<u8", 1)[0])
            self.planes.append((zeros, take("<u8", blocks * (STEP // 64)), take("<u4", blocks + 1)))

    def rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        _, bits, before = self.planes[plane]
        block = at // STEP
        out = before[block].astype(np.int64)
        word, inside = at // 64, at % 64
        for k in range(STEP // 64):
            w = block * (STEP // 64) + k
            part = np.where(w < word, ~np.uint64(0), np.where(w == word, (np.uint64(1) << inside.astype(np.uint64)) - np.uint64(1), np.uint64(0)))
            if len(bits):
                out += np.bitwise_count(bits[np.minimum(w, len(bits) - 1)] & part)
        return out

    def select(self, plane: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Position of the n-th (from 0) one or zero."""
        _, bits, before = self.planes[plane]
        total = before.astype(np.int64) if bit else np.arange(len(before)) * STEP - before
        block = np.searchsorted(total, nth, side="right") - 1
        own = bits.reshape(-1, STEP // 64)[block].view(np.uint8)
        flat = np.unpackbits(own, axis=1, bitorder="little") == bit
        return block * STEP + (np.cumsum(flat, axis=1) > (nth - total[block])[:, None]).argmax(axis=1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Tokens at positions of the shard."""
        at, code = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for p, (zeros, bits, _) in enumerate(self.planes):
            bit = (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1
            ones = self.rank1(p, at)
            at = np.where(bit, zeros + ones, at - ones)
            code = code << 1 | bit
        return self.alphabet[code]

    def span(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Range of a token's occurrences within a range of positions, below the last plane."""
        found = np.flatnonzero(self.alphabet == token)
        if not len(found):
            return 0, 0
        for p, (zeros, _, _) in enumerate(self.planes):
            ones = self.rank1(p, np.array([start, end]))
            if found[0] >> (len(self.planes) - 1 - p) & 1:
                start, end = zeros + int(ones[0]), zeros + int(ones[1])
            else:
                start, end = start - int(ones[0]), end - int(ones[1])
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in a range of positions."""
        low, high = self.span(token, start, self.n if end is None else end)
        return high - low

    def find(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Positions of a token in a range, in order."""
        low, high = self.span(token, start, self.n if end is None else end)
        at = np.arange(low, high)
        for p in range(len(self.planes) - 1, -1, -1):
            if not len(at):
                break
            zeros = self.planes[p][0]
            bit = int(np.flatnonzero(self.alphabet == token)[0]) >> (len(self.planes) - 1 - p) & 1
            at = self.select(p, bit, at - zeros if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All tokens, from the last plane up: each plane puts back what it parted."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        code = np.zeros(self.n, kind)
        for p in range(len(self.planes) - 1, -1, -1):
            zeros, bits, _ = self.planes[p]
            bit = np.unpackbits(bits.view(np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(code)
            above[np.flatnonzero(~bit)] = code[:zeros]
            above[np.flatnonzero(bit)] = code[zeros:] | kind(1 << (len(self.planes) - 1 - p))
            code = above
        return self.alphabet[code]


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of every text and ``end_id``, documents in id order (NULL first, equal ids by text); NULL text is empty."""
    blocks = Blocks(docs.select(id_col, text_col), id_col, text_col, shard_bytes)

    def run(key, rows):
        code = encoder(path or token_path())
        rows = ordered(rows)
        parts = [x for part in rows.column("text").chunks for x in code.encode_column(part, end_id)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        data = encode(rows.column("doc").to_pylist(), sizes, ids)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})

    made = blocks.map(run, SHARD).withColumn("file", F.col("shard"))
    made.write.option("compression", "zstd").option("maxRecordsPerFile", 1).partitionBy("file").parquet(folder)


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """``(shard, n_docs, n_tokens, data, start)``: the shards and the tokens before each."""
    rows = spark.read.schema(SHARD).parquet(folder)
    # One short row per shard, no data: the only window over all shards.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("shard", "n_tokens").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("shard", "start")
    return rows.join(starts, "shard")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc, start, n_tokens, ids)`` for every document: its ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
                shard = Shard(data.as_py())
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.sizes)
                cut = list(zip((ends - shard.sizes).tolist(), ends.tolist(), strict=True))
                for at in range(0, len(cut), 512):
                    own = cut[at : at + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.docs[at : at + 512], pa.int64()), pa.array([start + s for s, _ in own], pa.int64()), pa.array([e - s for s, e in own], pa.int64()), pa.array([ids[s:e].tobytes() for s, e in own], pa.binary())],
                        ["doc", "start", "n_tokens", "ids"],
                    )

    return shards(spark, folder).select("start", "data").mapInArrow(run, "doc long, start long, n_tokens long, ids binary")


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """``(shard, position)`` of every occurrence of a token, from the start of all documents."""

    def run(batches):
        for batch in batches:
            for number, start, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "data")), strict=True):
                at = Shard(data).find(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number, np.int64)), pa.array(at + start)], ["shard", "position"])

    return shards(spark, folder).select("shard", "start", "data").mapInArrow(run, "shard long, position long")
