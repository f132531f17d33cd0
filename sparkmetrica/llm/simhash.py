"""SimHash near-duplicates by pigeonhole blocks, and exact near-duplicates by Jaccard similarity.

Two 64-bit fingerprints that differ in at most ``distance`` bits agree on
``blocks - distance`` of any ``blocks`` blocks of bits, so every choice of that many
blocks is one join key (20 keys of about 32 bits for 6 blocks and 3 bits).

The pipeline links documents by SimHash first: fingerprints of their sets of distinct shingles, found by the same blocks, each
link then checked by the Jaccard similarity of the two sets. An exact search for what fingerprints miss follows: two sets with a similarity of t
or more share one of the first ``size - ceil(t * size) + 1`` shingles of each in any common order, so these are its join keys.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmetrica.llm.common import U, per_batch, rolling, words
from sparkmetrica.llm.components import components
from sparkmetrica.session import discard, settle

SEED = 42
CHUNK = 1 << 16  # shingles whose bits are counted at once
SMALL = 32  # buckets up to this size are joined row by row
LARGE = 1 << 14  # buckets above this size are split by further bits
WORDS = 8
WIDTH = 64 * WORDS  # bits of a sketch
SIMILAR = 0.8  # Jaccard similarity of near copies
COMMON = 64  # shingles more often than this among the first of the documents come last in their order
MOST = 1 << 18  # of them at most, the most frequent
BACK = 3  # earlier keys by which a large bucket tells that a pair meets in another one


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text as an unsigned number; 0 if there is no word."""
    found = words(text, lower=True)
    if not found:
        return 0
    if len(found) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    n = len(found) - shingle + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = found[start : start + CHUNK + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle)), strict=False)
        h = np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc, text_hash, fp)`` for every row of ``docs``; ``text_hash`` tells rows apart that share an id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), pa.array(fps.view(np.int64))], ["doc", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(per_batch(run), "doc long, text_hash long, fp long")


def split_bits(mask: int, blocks: int, keep: int) -> list[int]:
    """Wider masks: ``mask`` with every choice of ``keep`` of ``blocks`` blocks of the bits it lacks."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [sum(1 << int(i) for i in part) for part in np.array_split(free, min(blocks, len(free)))]
    keep = max(0, keep - (blocks - len(cut)))
    return [mask | sum(c) for c in combinations(cut, keep)]


def with_keys(rows: DataFrame, blocks: int, distance: int) -> DataFrame:
    """``(mask, fp)`` rows refined by every further choice of blocks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        out_m, out_f = [], []
        for m in np.unique(masks):
            own = fps[masks == m]
            wider = np.array(split_bits(int(m) & (2**64 - 1), blocks, blocks - distance), np.uint64).view(np.int64)
            out_m.append(np.repeat(wider, len(own)))
            out_f.append(np.tile(own, len(wider)))
        m, f = np.concatenate(out_m), np.concatenate(out_f)
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(m & f), pa.array(f)], ["mask", "key", "fp"])

    return rows.mapInArrow(per_batch(run), "mask long, key long, fp long").distinct()


def linked_inside(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one bucket, by a search that visits each fingerprint once."""
    rest = np.unique(fps)
    ends: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                new = rest[near]
                starts.append(np.full(len(new), x, np.int64))
                ends.append(new)
                queue.extend(new)
                rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


def links(fps: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """Edges ``(a, b)`` between the distinct values of ``fps.fp``.

    They connect exactly the fingerprints that links of ``distance`` or fewer bits connect.
    Buckets of one key are sized first: small ones are joined, those up to ``LARGE``
    are searched in one task, and still larger ones are split by further bits of
    their own until no bucket is larger, which loses no pair. Only the question
    whether any is left reaches the driver.
    """

    def search(key, bucket):
        a, b = linked_inside(bucket.column("fp").to_numpy(), distance)
        return pa.table({"a": a, "b": b})

    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    masks = [m - (1 << 64) if m >> 63 else m for m in split_bits(0, blocks, blocks - distance)]
    cuts = F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks])
    rows = fps.select("fp", F.inline(cuts)).select("mask", "key", "fp")
    out = None
    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = settle(rows.join(sizes, ["mask", "key"]))
        small, left = (shared.where(f"size <= {SMALL}").select("mask", "key", F.col("fp").alias(c)) for c in "ab")
        pairs = small.join(left, ["mask", "key"]).where((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
        large = shared.where(f"size > {SMALL} AND (size <= {LARGE} OR bit_count(mask) >= {64 - distance})")
        found = pairs.union(large.select("mask", "key", "fp").groupBy("mask", "key").applyInArrow(search, "a long, b long"))
        out = found if out is None else out.union(found)
        hot = shared.where(f"size > {LARGE} AND bit_count(mask) < {64 - distance}")
        if hot.isEmpty():
            return out.distinct()
        rows = settle(with_keys(hot.select("mask", "fp"), blocks, distance))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, blocks: int = 6
) -> DataFrame:
    """``(doc, text_hash, fp, component)`` for every row of ``docs``.

    ``component`` is the smallest id reachable over links of ``distance`` or fewer
    differing bits; fingerprint 0 (no word, NULL text) is linked like any other. Rows with
    a NULL id take part and are never the smallest; a component of such rows only has
    component NULL. Repeated rows get equal answers. Other columns are not read.
    """
    rows = settle(fingerprints(docs, id_col, text_col, shingle))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc").alias("first")))
    roots = components(links(nodes.select("fp"), distance, blocks)).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = settle(joined.groupBy("root").agg(F.min("first").alias("component")))  # so that the join may split a hot root
    labels = joined.join(smallest, "root").select("fp", "component")
    return rows.join(labels, "fp").select("doc", "text_hash", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of every group of similar documents: the one with the smallest id.

    Similar documents have sets of distinct shingles with a Jaccard similarity of ``similarity`` or more. SimHash finds most of
    them, an exact search the others; all such pairs are found at every size of ``docs``. A group of rows with NULL ids only keeps the one with the smallest text
    hash; of rows equal in id and text one stays. Texts without a word are one group. All columns are kept.
    """
    found = similar_documents(docs, id_col, text_col, shingle, similarity)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "text_hash")).alias("best"))
    best = best.select(F.col("best.doc").alias("doc"), F.col("best.text_hash").alias("hash")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # no column of the input clashes
    keyed = docs.toDF(*names)
    row_id, row_text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    keyed = keyed.withColumns({"row_doc": row_id.cast("long"), "row_hash": F.xxhash64(row_text)})
    same = keyed["row_doc"].eqNullSafe(best["doc"]) & (keyed["row_hash"] == best["hash"])
    kept = keyed.join(best, same, "left_semi").dropDuplicates(["row_doc", "row_hash"])
    return kept.select(*names).toDF(*docs.columns)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit names of the distinct word shingles of a text; a text of fewer words is one shingle, one without a word has none."""
    found = words(text, lower=True)
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)), min(shingle, len(found))))


def set_fingerprint(names: np.ndarray) -> int:
    """SimHash of a set of shingles as an unsigned number: a bit is set if over half of their names have it; 0 of none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(names), CHUNK):
        ones += np.unpackbits(names[start : start + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(names), bitorder="little").view(np.uint64)[0])


def sketch(names: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether the number of shingles that fall on each of ``width`` bits is odd, as unsigned words.

    Two sketches differ in at most as many bits as there are shingles in one set only.
    """
    odd = np.bincount((names & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def wide_sketch(names: np.ndarray) -> bytes:
    """A sketch of two to four bits a shingle, so that it rules pairs of long texts out as well."""
    return sketch(names, max(64, 1 << (2 * len(names)).bit_length())).tobytes()


def wide_apart(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ; the wider one is folded to the width of the other first."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def first_shingles(names: np.ndarray, common: np.ndarray, similarity: float, times: int = 1) -> np.ndarray:
    """So many first shingles of a set, those in ``common`` (sorted) last, that similar sets share one; or ``times`` as many."""
    n = len(names)
    if n and len(common):
        late = common[np.minimum(np.searchsorted(common, names), len(common) - 1)] == names
        names = np.concatenate([names[~late], names[late]])
    return names[: times * (n - math.ceil(similarity * n - 1e-9) + 1)]


def common_shingles(texts: DataFrame, shingle: int, similarity: float) -> np.ndarray:
    """Names of shingles that many texts would have among their first. Which they are changes the size of buckets only, not the pairs found."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        none = np.zeros(0, np.uint64)
        names, n = np.unique(np.concatenate([none, *(first_shingles(shingles(t.as_py(), shingle), none, similarity, 2) for t in batch.column("text"))]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    counts = texts.mapInArrow(per_batch(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(f"n > {COMMON}")
    counts = settle(counts.withColumn("power", F.floor(F.log2("n")).cast("int")))
    least, total = 99, 0
    for power, n in sorted(counts.groupBy("power").count().collect(), reverse=True):
        total += n
        if total > MOST:
            break
        least = power
    return np.sort(np.array([r[0] for r in counts.where(F.col("power") >= least).select("key").collect()], np.int64).view(np.uint64))


def may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and sketches of two sets allow the similarity; true of all that have it."""
    columns = [f"w{i}" for i in range(WORDS)]
    apart = sum((F.bit_count(F.col(a + x).bitwiseXOR(F.col(b + x))) for x in columns), F.lit(0))
    m, n = F.col(a + "size"), F.col(b + "size")
    return (F.least(m, n) >= F.greatest(m, n) * similarity - 1e-9) & (apart <= (m + n) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def block_pairs(large: DataFrame) -> DataFrame:
    """Rows of ``large(key, node, root, ..)`` with ``part``, once for each pair ``(i, j)`` of blocks of their bucket that is to be compared.

    The rows of a bucket's most frequent component make blocks of up to about ``LARGE`` rows with numbers below zero, the others blocks from 0 on.
    All pairs of blocks are there but those within the most frequent component, which is connected already.
    """
    roots = large.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    main = roots.groupBy("key").agg(F.max(F.struct("rows", "root")).alias("main"), F.sum("rows").alias("all"))
    up = lambda n: F.ceil(n / F.lit(LARGE)).cast("long")
    main = main.select("key", F.col("main.root").alias("main"), up(F.col("main.rows")).alias("mains"), up(F.col("all") - F.col("main.rows")).alias("odds"))
    rows = large.join(main, "key").withColumn("odd", F.col("root") != F.col("main"))
    place = F.when(F.col("odd"), F.pmod(F.xxhash64("node"), F.col("odds"))).otherwise(-1 - F.pmod(F.xxhash64("node"), F.col("mains")))
    others = F.when(F.col("odd"), F.sequence(-F.col("mains"), F.col("odds") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("odds") - 1))
    rows = rows.withColumn("part", place).withColumn("other", F.explode(others))
    return rows.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("main", "mains", "odds", "odd", "other")


def candidates_inside(similarity: float):
    """Searches one pair of blocks of a bucket for pairs of different components that may be similar.

    ``p0`` and so on are the last keys of a row's node before this one, in one order of all keys, or this one where there are no more. Two nodes that
    share one of them meet in that key's bucket too, so only the first bucket that two nodes share has to name them, and few others do.
    """
    columns, back_to = [f"w{i}" for i in range(WORDS)], [f"p{i}" for i in range(BACK)]

    def search(key, bucket):
        w = np.stack([bucket.column(c).to_numpy() for c in columns], axis=1).view(np.uint64)
        node, size, root, part = (bucket.column(c).to_numpy() for c in ("node", "size", "root", "part"))
        earlier, this = np.stack([bucket.column(c).to_numpy() for c in back_to], axis=1), key[0].as_py()
        names, back, n = np.unique(root, return_inverse=True, return_counts=True)
        lows, highs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        across = key[1].as_py() != key[2].as_py()
        for x in np.flatnonzero(back != n.argmax()):  # of two components one is not the largest
            far = root != root[x]
            if across:
                far &= part != part[x]
            other = np.flatnonzero(far & (np.minimum(size, size[x]) >= np.maximum(size, size[x]) * similarity - 1e-9))
            most = (size[other] + size[x]) * ((1 - similarity) / (1 + similarity)) + 1e-9
            other = other[np.bitwise_count(w[other] ^ w[x]).sum(axis=1) <= most]
            other = other[~np.isin(earlier[other], earlier[x][earlier[x] != this]).any(axis=1)]
            lows.append(np.minimum(node[other], node[x]))
            highs.append(np.maximum(node[other], node[x]))
        pairs = np.unique(np.stack([np.concatenate(lows), np.concatenate(highs)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return search


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets of shingles have the similarity.

    ``texts(text_hash, text)`` has the text of every ``text_hash`` of ``nodes``. Wide sketches rule pairs out before texts travel.
    """

    def rough(batch: pa.RecordBatch) -> pa.RecordBatch:
        most = (batch.column("m").to_numpy() + batch.column("n").to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-9
        near = [wide_apart(x.as_py(), y.as_py()) <= d for x, y, d in zip(batch.column("aw"), batch.column("bw"), most.tolist(), strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, last, y = [], None, None
        for a, b, node in zip(batch.column("at"), batch.column("bt"), batch.column("b").to_pylist(), strict=True):
            x = shingles(a.as_py(), shingle)
            if node != last:  # pairs come in runs of one b
                last, y = node, shingles(b.as_py(), shingle)
            both = len(np.intersect1d(x, y, assume_unique=True))
            same.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        return batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    left, right = (nodes.select(F.col("node").alias(c), F.col("size").alias(s), F.col("wide").alias(c + "w")) for c, s in ("am", "bn"))
    pairs = settle(pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "aw", "bw").mapInArrow(per_batch(rough), "a long, b long"))
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = settle(nodes.select("node", "text_hash").join(needed, "node", "left_semi"))
    found = texts.join(needed, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    own = settle(found.join(needed, "text_hash").select("node", "text"))
    left, right = (own.select(F.col("node").alias(c), F.col("text").alias(c + "t")) for c in "ab")
    out = settle(pairs.join(left, "a").join(right, "b").select("a", "b", "at", "bt").mapInArrow(per_batch(run), "a long, b long"))
    discard(pairs, needed, own)
    return out


def simhash_pairs(nodes: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that connect what SimHash links.

    The nodes of one fingerprint are linked to its smallest node, and these to each other where :func:`links` links their fingerprints.
    """
    hubs = settle(nodes.groupBy("fp").agg(F.min("node").alias("hub")))
    near = links(hubs.select("fp"), distance, blocks)
    a, b = (hubs.select(F.col("fp").alias(c), F.col("hub").alias(c + "hub")) for c in "ab")
    across = near.join(a, "a").join(b, "b").select(F.col("ahub").alias("a"), F.col("bhub").alias("b"))
    return nodes.join(hubs, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).union(across)


def similar_roots(nodes: DataFrame, keys: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``(node, root)`` for every node: those that pairs of the similarity connect share a root.

    Pairs that SimHash links come first, then all that this has not connected: every pair of the similarity shares one of ``keys(key, node)``.
    The nodes of a key are compared with its smallest node first, then with each other where they are still apart. Buckets
    above ``LARGE`` are compared block against block, which loses no pair.
    """
    columns = ["size", *[f"w{i}" for i in range(WORDS)]]
    left, right = (nodes.select(F.col("node").alias(c), *[F.col(x).alias(c + x) for x in columns]) for c in "ab")
    near = simhash_pairs(nodes).join(left, "a").join(right, "b").where(may_be_similar("a", "b", similarity)).select("a", "b")
    linked = verified(settle(near), nodes, texts, shingle, similarity)
    roots = settle(components(linked))
    bucket = Window.partitionBy("key")
    shared = keys.repartition("key").distinct().withColumns({"n": F.count(F.lit(1)).over(bucket), "low": F.min("node").over(bucket)}).where("n > 1")
    shared = settle(shared)
    at, up = (roots.select(F.col("node").alias(c), F.col("root").alias(c + "root")) for c in "ab")
    stars = shared.where("low <> node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(at, "a", "left").join(up, "b", "left").where("aroot IS NULL OR broot IS NULL OR aroot <> broot").select("a", "b")
    stars = settle(stars.join(left, "a").join(right, "b").where(may_be_similar("a", "b", similarity)).select("a", "b"))
    roots = components(linked.union(verified(stars, nodes, texts, shingle, similarity)))
    labelled = settle(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", *columns))
    order = Window.partitionBy("node").orderBy("key")
    earlier = {f"p{i}": F.coalesce(F.lag("key", i + 1).over(order), "key") for i in range(BACK)}
    full = shared.select("key", "node", "n").withColumns(earlier).join(labelled.select("node", "root"), "node")
    unlike = full.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    apart = settle(full.join(unlike, "key"))
    discard(shared)
    full = apart.drop("root").join(labelled, "node")
    small = full.where(f"n <= {SMALL}")
    a, b = (small.select("key", F.col("node").alias(c), *[F.col(x).alias(c + x) for x in ("root", *columns)]) for c in "ab")
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("aroot") != F.col("broot")) & may_be_similar("a", "b", similarity)).select("a", "b")
    large = full.where(f"n > {SMALL}")
    more = block_pairs(large).groupBy("key", "i", "j").applyInArrow(candidates_inside(similarity), "a long, b long")
    left_over = settle(pairs.union(more).distinct().join(stars, ["a", "b"], "left_anti"))
    discard(apart, stars)
    more = verified(left_over, nodes, texts, shingle, similarity)
    a, b = (labelled.select(F.col("node").alias(c), F.col("root").alias(c + "root")) for c in "ab")
    joined = components(more.join(a, "a").join(b, "b").select(F.col("aroot").alias("a"), F.col("broot").alias("b")))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
    return labelled.select("node", "root").join(joined, "root", "left").select("node", F.coalesce("last", "root").alias("root"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """``(doc, text_hash, component)`` for every row: rows linked by similar sets of shingles share the smallest id of their group."""
    columns = [f"w{i}" for i in range(WORDS)]

    def named(sets: list[np.ndarray]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)

    def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py(), shingle) for t in batch.column("text")]
        w = np.array([sketch(x) for x in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
        size = np.array([len(x) for x in sets], np.int64)
        fp = np.array([set_fingerprint(x) for x in sets], np.uint64).view(np.int64)
        own = [pa.array(named(sets)), pa.array(size), pa.array(fp), pa.array([wide_sketch(x) for x in sets], pa.binary()), *(pa.array(np.ascontiguousarray(w[:, i])) for i in range(WORDS))]
        return pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), *own], ["doc", "text_hash", "node", "size", "fp", "wide", *columns])

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py(), shingle) for t in batch.column("text")]
        node, at = np.unique(named(sets), return_index=True)  # copies have the same keys
        first = [first_shingles(sets[i], common, similarity) for i in at]
        key = np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(node, [len(x) for x in first]))], ["key", "node"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    only = rows.select("text")
    common = common_shingles(only, shingle, similarity)
    shape = "doc long, text_hash long, node long, size long, fp long, wide binary, " + ", ".join(f"{c} long" for c in columns)
    found = settle(rows.mapInArrow(per_batch(sketched), shape))
    nodes = settle(found.groupBy("node", "size", "fp", *columns).agg(F.min("doc").alias("first"), F.min("text_hash").alias("text_hash"), F.first("wide").alias("wide")))
    keys = only.mapInArrow(per_batch(keyed), "key long, node long")
    roots = similar_roots(nodes.drop("first"), keys, rows.select("text_hash", "text"), shingle, similarity)
    joined = settle(nodes.select("node", "first").join(roots, "node").select("node", "first", "root"))
    smallest = settle(joined.groupBy("root").agg(F.min("first").alias("component")))  # so that the join may split a hot root
    labels = joined.join(smallest, "root").select("node", "component")
    return found.join(labels, "node").select("doc", "text_hash", "component")
