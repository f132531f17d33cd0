"""The registered text queries on small tables with every odd case, against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmetrica.llm import anchors, decontam, langid, licences, packing, parsing, quality, simhash, suffixes, wavelet
from sparkmetrica.llm.common import ORACLES, QUERIES
from sparkmetrica.llm.queries import LICENCE_SQL  # noqa: F401  (registers all)
from sparkmetrica.session import shared_folder

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, word string, block string, n_words string, kept string"
ENGLISH = "the cat sat on the mat and the dog ran to the other side of the road with a ball in its mouth while it rained all day long".split()


def sentence(rng, n):
    return " ".join(rng.choice(ENGLISH, n))


@pytest.fixture(scope="module")
def rows():
    """Repeated rows, copies, near copies, a shared passage, NULLs in every column, empty, blank and very long texts, equal ids."""
    rng = np.random.default_rng(11)
    base = [sentence(rng, int(n)) for n in rng.integers(1, 120, 40)]
    passage = sentence(rng, 60)
    texts = [*base, base[3], base[3], base[5] + " more", base[7] + " " + passage, passage + " " + base[8], "", None, "  \n\t ", "x", "123 456 ?!"]
    texts += [sentence(rng, 30_000) + " " + passage, "ä" * 150, base[9].upper(), " ".join([base[10]] * 3)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(3, base[3]), (5, base[11]), (None, base[12]), (None, None), (None, "only here " + base[13]), (-4, passage), (2**53 + 1, base[14]), (2**53, base[14])]
    return [(i, t, None if k % 7 == 0 else "en" if k % 2 else "fr", None if k % 5 == 0 else f"src{k % 3}", None, "n", "w", "b", "c", "k") for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order(rows):
    """Distinct rows by id, NULL first, then by text, NULL first; with the times each occurs."""
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def repeats(rows, parts, join, window):
    """Brute force of both repeat removals: (id, kept, size, removed) of every row."""
    seen, out = set(), []
    for i, t in in_order(rows):
        w = parts(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = join(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out.append((i, join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_word_repeats(docs, rows):
    got = anchors.drop_repeats(docs, window=20)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "word", "block", "kept", "n_words", "n_removed", "span_starts", "span_lengths"]
    assert "n_words" in got.columns and got.schema["n_words"].dataType == T.LongType()
    found = got.collect()
    want = repeats(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), lambda w: " ".join(w), 20)
    same([(r.doc_id, r.text, r.n_words, r.n_removed) for r in found], want)
    assert all(sum(r.span_lengths) == r.n_removed for r in found) and sum(r.n_removed for r in found) > 100


def test_byte_repeats(docs, rows):
    got = suffixes.drop_repeats(docs, window=100).collect()
    want = repeats(rows, lambda t: [bytes([b]) for b in t.encode()], lambda w: b"".join(w), 100)
    same([(r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed) for r in got], want)
    assert all(r.text == bytes(r.kept).decode("utf-8", "ignore") and sum(r.span_lengths) == r.n_removed for r in got)


def test_simhash_components(docs, rows):
    got = simhash.near_duplicates(docs, shingle=3, distance=3).collect()
    fps = [simhash.fingerprint(r[1], 3) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    same([(r.doc, r.fp % 2**64, r.component) for r in got], [(r[0], f, least[g]) for r, f, g in zip(rows, fps, group, strict=True)])


def test_hot_buckets_are_split_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    fps = sorted({int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in rng.integers(0, 2**62, 3) for a, b in rng.integers(0, 24, (60, 2))})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups(frame):
        up = {f: f for f in fps}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for r in frame.collect():
            a, b = top(r.a), top(r.b)
            up[max(a, b)] = min(a, b)
        return [top(f) for f in fps]

    every = spark.createDataFrame([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], "a long, b long")
    want = groups(every)
    for small, large in ((32, 1 << 14), (4, 1 << 14), (4, 12)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "LARGE", large)
        assert groups(simhash.links(table)) == want


def test_one_document_of_each_group_stays(spark, docs, rows):
    rng = np.random.default_rng(3)
    long = [" ".join(f"w{int(x)}" for x in rng.integers(0, 5000, 300)) for _ in range(6)]
    near = []
    for k, t in enumerate(long):
        w = t.split()
        w[100] = "changed"
        near += [(1000 + k, t), (2000 + k, " ".join(w)), (1000 + k, t)]
    extra = spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None) for i, t in near], SCHEMA)
    kept = simhash.drop_near_duplicates(docs.union(extra))
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len(set(found)) and sorted(i for i, _ in found if i is not None and 1000 <= i < 3000) == [1000 + k for k in range(6)]
    texts = [t for _, t in found]
    assert len({t for t in texts if t and t.strip()}) == len([t for t in texts if t and t.strip()])
    alone = [i for i in range(40) if i not in (7, 8, 9, 10, 11, 12, 13) and len(rows[i][1].split()) > 60]
    assert set(alone) <= {i for i, _ in found}


def near_groups(texts, similarity=0.8):
    """Groups by the exact Jaccard similarity of the distinct five-word shingles of every pair."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up, alike = list(range(len(texts))), []

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            s = both / (len(sets[i]) + len(sets[j]) - both)
            alike.append(s)
            if s >= similarity:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], alike


def pairs_of_similarity(seed, n):
    """``n`` texts of 60 to 400 words, each followed by a copy with some words changed; similarities from 0.7 to 0.95."""
    rng = np.random.default_rng(seed)
    texts = []
    for k in range(n):
        w = [f"w{int(x)}" for x in rng.integers(0, 50_000, int(rng.integers(60, 400)))]
        texts.append(" ".join(w))
        want, size = 0.7 + 0.25 * k / n, len(w) - 4
        for at in rng.choice(len(w) // 5, max(1, round((1 - want) / (1 + want) * size / 5)), replace=False):
            w[5 * int(at)] = f"new{k}"
        texts.append(" ".join(w))
    return texts


def test_near_copies_are_those_of_exact_jaccard(spark):
    texts = pairs_of_similarity(4, 150)
    want, alike = near_groups(texts)
    assert sum(0.8 <= s < 0.83 for s in alike) > 5 and sum(0.77 < s < 0.8 for s in alike) > 5
    found = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc: r.component for r in found.collect()} == dict(enumerate(want))


def test_hot_buckets_keep_all_near_copies(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = []
    for group in range(3):
        base = [f"g{group}w{k}" for k in range(200)]
        for k in range(70):
            w = list(base)
            for at in rng.choice(40, int(rng.integers(2, 6)), replace=False):
                w[5 * int(at)] = f"x{group}n{k}"
            texts.append(" ".join(w))
    stream = [f"s{k}" for k in range(700)]
    texts += [" ".join(stream[8 * k : 8 * k + 100]) for k in range(60)]
    want, _ = near_groups(texts)
    assert 6 < len(set(want)) < 200
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small, large in ((32, 1 << 14), (4, 1 << 14), (4, 12)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "LARGE", large)
        found = simhash.similar_documents(table).collect()
        assert {r.doc: r.component for r in found} == dict(enumerate(want))


def test_the_pipeline_links_by_simhash_first(spark, monkeypatch):
    """The candidates are those of fingerprints in pigeonhole blocks; what they miss is left to the exact search."""
    texts = pairs_of_similarity(8, 40)
    sets = [simhash.shingles(t, 5) for t in texts]
    fps = [simhash.set_fingerprint(x) for x in sets]
    asked, pairs, plain = [], [], simhash.links

    def links(frame, *more):
        asked.append({r.fp % 2**64 for r in frame.collect()})
        found = plain(frame, *more)
        pairs.extend((r.a % 2**64, r.b % 2**64) for r in found.collect())
        return found

    monkeypatch.setattr(simhash, "links", links)
    found = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc: r.component for r in found.collect()} == dict(enumerate(near_groups(texts)[0]))
    assert asked == [set(fps)]
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3} and pairs


def test_a_repeated_line_makes_no_near_copies(spark):
    line = " ".join(f"line{k}" for k in range(12))
    texts = []
    for d in range(12):
        own = [f"d{d}w{k}" for k in range(100)]
        texts.append(" ".join([*own, *[line] * (10 if d % 2 else 20)]))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(table).collect()) == list(range(12))


def test_wavelet_files(spark, docs, rows):
    from tokenizers import Tokenizer

    from sparkmetrica.llm.tokens import token_path

    plain = Tokenizer.from_file(token_path())
    place = shared_folder(spark)
    wavelet.write_shards(docs, place)
    got = wavelet.read_documents(spark, place).orderBy("start").collect()
    want, at = [], 0
    for i, t in in_order(rows):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), ids.tobytes()))
        at += len(ids)
    assert [(r.doc, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    every = np.frombuffer(b"".join(w[3] for w in want), "<u4")
    token = int(np.bincount(every).argmax())
    assert sorted(r.position for r in wavelet.occurrences(spark, place, token).collect()) == np.flatnonzero(every == token).tolist()


def test_packing(docs, rows):
    from sparkmetrica.llm.tokens import Encoder, token_path

    code = Encoder(token_path())
    got = packing.pack(docs, group_size=30).collect()
    want = defaultdict(int)
    for r in rows:
        ids = code.encode([r[1]])[0] + b"\0\0\0\0"
        for k, (s, n) in enumerate(packing.piece_bounds(len(ids) // 4, 2048)):
            want[(r[0], k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))] += 1
    have, filled = defaultdict(int), defaultdict(list)
    for r in got:
        have[(r.doc, r.piece, r.start, r.length, r.crc)] += 1
        filled[r.sequence].append((r.place, r.length))
    assert have == want
    for places in filled.values():
        at = 0
        for place, n in sorted(places):
            assert place == at
            at += n
        assert at <= 2048
    assert len(filled) <= math.ceil(sum(r.length for r in got) / 2048) + len(rows) // 15


def test_parsing_neighbours(docs, rows):
    got = {(r.doc, r.fingerprint, r.edited_sha256): r for r in parsing.compare_neighbours(docs).collect()}
    ordered = in_order(rows)
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        changed = parsing.edited(t or "", after or "")
        (mine, other, new), whole = parsing.fingerprints([t or "", after or "", changed])[0], parsing.fingerprints([t or ""])[1]
        key = (i, parsing.as_text(mine[None], whole)[0], hashlib.sha256(changed.encode()).hexdigest())
        assert got[key].n_chars == len(t or "")
        assert got[key].near_edited == pytest.approx(float(parsing.likeness(mine, new))) and got[key].near_next == pytest.approx(float(parsing.likeness(mine, other)))
    alone = parsing.fingerprint(docs).collect()
    assert {(r.id, r.fingerprint) for r in alone} == {k[:2] for k in got} and len(alone) == len(rows)


def test_contamination(spark, docs, rows):
    rng = np.random.default_rng(11)
    items = [(1, rows[20][1]), (1, rows[20][1]), (2, " ".join(rows[50][1].split()[500:530])), (3, "w5"), (4, ""), (5, None), (None, rows[21][1]), (6, "cat sat"), (7, sentence(rng, 12))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc string")

    def grams(t, n):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for item, text in set(items):
        n = min(5, len((text or "").split()))
        asked = grams(text, n) if n else set()
        for r in rows:
            shared = len(asked & grams(r[1], n)) if n else 0
            if asked and shared >= 0.8 * len(asked) - 1e-9:
                want.add((r[0], r[1], item, shared, len(asked)))
    got = decontam.contamination(docs, bench).collect()
    assert {(r.doc, r.item, r.shared, r.shingles) for r in got} == {(w[0], *w[2:]) for w in want} and len(want) > 5
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(r[0], r[1]) for r in rows if (r[0], r[1]) not in {(w[0], w[1]) for w in want}])


def test_contamination_in_blocks_of_items(docs, spark, rows, monkeypatch):
    bench = spark.createDataFrame([(k, rows[k][1]) for k in range(0, 40, 3)], "item_id long, text string")
    whole = decontam.contamination(docs, bench).orderBy("doc", "item", "shared").collect()
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 200)
    assert decontam.contamination(docs, bench).orderBy("doc", "item", "shared").collect() == whole


def test_licences(spark):
    apache, mit = licences.TEMPLATES[0][1], licences.TEMPLATES[11][1]
    files = [
        (1, "/a/LICENSE", apache), (2, "/a/b/c/x.py", "print(1)\n# " + mit + "\nmore"), (3, "/a/b/y.py", "nothing"), (4, "/a/b/c/d/LICENSE.txt", mit + "\n\nand much else besides that goes on for long"),
        (5, "/a/b/c/d/e/z.py", None), (6, None, apache + "."), (7, None, None), (8, "/q/r.py", ""), (9, "top.py", "licensed"), (10, "/a2/x.py", "words"), (3, "/a/b/y.py", "nothing"),
    ]
    rng = np.random.default_rng(0)
    files += [(100 + k, f"/other/{k}.txt", sentence(rng, 40)) for k in range(60)]
    table = spark.createDataFrame([(*f, "w") for f in files], "id long, path string, text string, word string")
    got = {r.id: (r.licence, r.inherited, r.licence_dir) for r in licences.scan(table).collect()}
    assert got[1] == ("Apache-2.0", False, None) and got[2] == ("MIT", False, None) and got[3] == ("Apache-2.0", True, "/a")
    assert got[4] == ("MIT", False, None) and got[5] == ("MIT", True, "/a/b/c/d") and got[6] == ("Apache-2.0", False, None)
    assert got[7] == got[8] == got[9] == got[10] == (None, False, None)
    assert licences.scan(table).count() == len(files)


def test_quality_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality.score(docs, quality.fit(docs)).join(labels.withColumnRenamed("doc_id", "id"), "id")
    agree = found.groupBy("quality").agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")).alias("share")).collect()
    assert all(r.share > 0.97 for r in agree) and len(agree) == 2


def test_quality_odd_rows(docs, rows):
    model = quality.fit(docs)
    got = quality.score(docs, model)
    assert got.count() == len(rows) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    blank = {(r.doc_id) for r in docs.where("text IS NULL OR trim(text) = ''").collect()} - {None}
    assert {r.id for r in got.where("score = 0").collect()} >= blank - {5, 3}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("keep").count()


def test_language_held_out(spark):
    got = QUERIES["op3_langid"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").where("held_out")
    assert held.count() > 200 and held.where("lang = lang_pred").count() > 0.98 * held.count()
    assert got.where("held_out <> (crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1)").count() == 0


def test_language_odd_rows(docs, rows):
    model = langid.fit(docs, "doc_id", "text", "lang")
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    letters = sum(1 for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    assert sum(r.lang_pred != "und" for r in got) == letters and all(0 <= r.score <= 1 for r in got)
    assert langid.fit(docs.where("lang IS NULL"), "doc_id", "text", "lang") is None


def test_language_sample_is_bounded(spark, monkeypatch):
    """Each language has its share in the sample, whether its rows are repeated, without id, or few."""
    same = [(7, "the same words again and again", "en")] * 3000 + [(None, f"des mots {k} et encore {k * k}", "fr") for k in range(900)] + [(9, "nur einmal", "de")]
    seen = []
    monkeypatch.setattr(langid, "SAMPLE", 120)
    monkeypatch.setattr(langid, "Model", lambda labels, places: seen.extend(labels))
    table = spark.createDataFrame(same, "id long, text string, lang string").repartition(5)
    langid.fit(table, "id", "text", "lang")
    assert seen.count("fr") == seen.count("en") == 40 and seen.count("de") == 1


def test_empty_tables(spark, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    place = shared_folder(spark)
    wavelet.write_shards(nothing, place)
    frames = [
        anchors.drop_repeats(nothing), suffixes.drop_repeats(nothing), simhash.near_duplicates(nothing), simhash.drop_near_duplicates(nothing), packing.pack(nothing),
        parsing.compare_neighbours(nothing), parsing.fingerprint(nothing), decontam.contamination(nothing, full), decontam.contamination(nothing, bench), decontam.decontaminate(nothing, bench),
        quality.score(nothing, quality.fit(nothing)), quality.keep_good(nothing, quality.fit(nothing)), langid.predict(nothing, langid.fit(nothing, "doc_id", "text", "lang")),
        licences.scan(nothing, "doc_id", "source", "text"), wavelet.read_documents(spark, place),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    from tests.parity import compare, connect

    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def test_contract_columns(spark):
    digest = QUERIES["op5_simhash"](spark, FOLDER)
    assert digest.columns == ["doc_id", "fingerprint", "component_id"]
    text = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").first()
    row = digest.where(F.col("doc_id") == text.doc_id).first()
    assert row.fingerprint == f"{simhash.fingerprint(text.text, 3):016x}"
    w = re.findall(r"[^\x20\x09-\x0D]+", text.text.lower())
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    assert int(row.fingerprint, 16) & 1 == (2 * sum(x & 1 for x in h) > len(h))


def test_licences_are_told_from_their_relatives(spark):
    lesser, affero, two = (next(t for name, t in licences.TEMPLATES if name == want) for want in ("LGPL-3.0", "AGPL-3.0", "GPL-2.0"))
    cases = {
        1: ("LGPL-3.0", lesser + ", or (at your option) any later version."), 2: ("GPL-2.0", two + ", or (at your option) any later version."), 3: ("AGPL-3.0", "# " + affero),
        4: ("BSD-2-Clause", "// SPDX-License-Identifier: BSD-2-Clause"), 5: ("ISC", "SPDX-License-Identifier: ISC"), 6: ("CC-BY-4.0", "Licensed under CC BY 4.0"),
        7: ("MIT", "Copyright 2020 Acme. Released under the MIT License."), 8: (None, "Licensed under CC BY-NC-SA 4.0"), 9: (None, "the licence of the house is under the stairs"),
    }
    rng = np.random.default_rng(5)
    filler = [(100 + k, f"/f{k}/x.txt", sentence(rng, 30)) for k in range(200)]
    got = []
    for times in (1, 20):  # the same rates in a larger table give the same licences
        more = [(1000 * t + i, f"/t{t}{p}", text) for t in range(times) for i, p, text in filler]
        files = [(k, f"/own{k}/x.py", text) for k, (_, text) in cases.items()] + more
        answer = licences.scan(spark.createDataFrame(files, "id long, path string, text string")).where("id < 10")
        got.append({r.id: r.licence for r in answer.collect()})
    assert got[0] == {k: name for k, (name, _) in cases.items()} == got[1]


def test_licence_templates_of_ones_own(spark):
    files = spark.createDataFrame([(1, "/a.txt", "House rules version 7 apply here"), (2, "/b.txt", "House rules version 8 apply here"), (3, "/c/d.txt", None)], "id long, path string, text string")
    own = [("House-7", "House rules version 7 apply here")]
    got = {r.id: (r.licence, r.inherited) for r in licences.scan(files, templates=own, telling={"House-7": ("house 7", "")}).collect()}
    assert got == {1: ("House-7", False), 2: ("House-7", True), 3: ("House-7", True)}  # the whole text is a notice, so the directory has it
    told = licences.scan(files.where("id <> 1"), templates=own, telling={"House-7": ("house 7", "")})
    assert [r.licence for r in told.collect()] == [None, None]


def test_quality_sample_is_bounded(spark, monkeypatch):
    """NULL ids and repeated rows neither fill the sample nor stay out of it together."""
    seen = []
    monkeypatch.setattr(quality, "TRAIN", 100)
    monkeypatch.setattr(quality, "Scorer", lambda rows, target: seen.append(len(rows)))
    loose = [(None, f"some words of text number {k} that differ") for k in range(2000)]
    same = [(3, "one text that all of these rows have in common")] * 2000
    for rows in (loose, same, loose + same):
        quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert 60 <= seen[0] <= 100 and seen[1] in (0, 100) and seen[2] <= 100
