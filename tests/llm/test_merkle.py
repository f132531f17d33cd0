"""The Merkle manifest against a tree that is built level by level."""

from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmetrica.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key string, place string, run string"


def h(*digests):
    return sha256("".join(digests).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def postorder(levels, level, index):
    below = range(2 * index, min(2 * index + 2, len(levels[level - 1]))) if level else ()
    return [*(d for i in below for d in postorder(levels, level - 1, i)), levels[level][index]]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 33, 100])
def test_log_is_the_postorder_and_positions_are_closed_form(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = levels_of(leaves)
    top = len(levels) - 1
    assert top == merkle.height(n)
    log = merkle.append_log(leaves, top)
    assert log == postorder(levels, top, 0)
    assert all(log[merkle.position(n, lv, i)] == d for lv, row in enumerate(levels) for i, d in enumerate(row))
    text = "".join(log)
    for i in range(n):
        path = merkle.siblings(text, n, top, i)
        assert merkle.fold(leaves[i], path) == levels[-1][0]
        assert n == 1 or merkle.fold(h("other"), path) != levels[-1][0]
        assert merkle.proof_hash(path) == h(*[levels[lv][(i >> lv) ^ 1] for lv in range(top) if (i >> lv) ^ 1 < len(levels[lv])])


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(int(i), f"text {i % 40} é", ["en", "en", "fr", None, "ä", ""][int(rng.integers(6))], None if i % 9 == 0 else "src", None if i % 8 == 0 else int(i)) for i in range(300)]
    out += [(5, "again", "en", "s", 1), (5, "again", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None), (None, "x", "en", "s", 2)]
    return out + [(-3, "long " * 20_000, "en", "s", 9), (8, "", "only", "", 0)] + [(77, "copy", "en", "s", 4)] * 150


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    made, ends = [], []
    for key in sorted(groups, key=lambda k: (k is not None, (k or "").encode())):
        own = sorted(((r, h(*[written(r[c]) for c in (0, 3, 2, 4, 1)])) for r in groups[key]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        levels = levels_of([leaf for _, leaf in own])
        ends.append(levels[-1][0])
        made.append((own, levels))
    top, out = levels_of(ends), []
    for g, (own, levels) in enumerate(made):
        for i, (r, leaf) in enumerate(own):
            path = [(lv[(at >> k)], lv[(at >> k) ^ 1] if (at >> k) ^ 1 < len(lv) else None, at >> k & 1) for tree, at in ((levels, i), (top, g)) for k, lv in enumerate(tree[:-1])]
            bad = r[0] is not None and r[4] is not None and crc32(str(r[0]).encode()) % 7 == 0
            fold = h(*[written(v) for v in (r[0], r[3], r[2], r[4] + 1 if bad else r[4], r[1])])
            for _, other, odd in path:
                fold = h(fold) if other is None else h(other, fold) if odd else h(fold, other)
            out.append((r[0], leaf, levels[-1][0], top[-1][0], h(*[o for _, o, _ in path if o]), fold, fold == top[-1][0]))
    return out, made


def proved(table):
    leaf = lambda n: merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, leaf(F.col("n_chars") + 1))
    manifest = merkle.build(table, "doc_id", "lang", leaf(F.col("n_chars")), claim=claim)
    out = merkle.verify(manifest.proofs(), "claim")
    return manifest, out.select("doc", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("levels", [2, 3, 12])
def test_manifest_against_brute_force(spark, rows, levels, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "RUN", 1 << levels)
    table = spark.createDataFrame([(*r, "l", "k", "p", "r") for r in rows], SCHEMA).repartition(6)
    manifest, found = proved(table)
    want, made = expected(rows)
    order = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in found.collect()), key=order)
    assert got == sorted(want, key=order)
    assert {r[-1] for r in got} == {True, False}
    nodes = {}
    for r in manifest.nodes().collect():
        nodes.setdefault(r.key, {})[r.position] = r.digest
    for own, tree in made:
        key = "-" if own[0][0][2] is None else "=" + own[0][0][2]
        assert nodes[key] == dict(enumerate(postorder(tree, len(tree) - 1, 0)))


def test_empty_table_has_no_tree(spark):
    manifest, found = proved(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and manifest.nodes().count() == 0
