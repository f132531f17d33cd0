"""The parts of the text operators that need no Spark, against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sparkmetrica.llm import anchors, blocks, common, decontam, langid, packing, parsing, quality, simhash, suffixes, tokens, wavelet

RNG = np.random.default_rng(5)


def some_texts(n, letters="ab c\nä", longest=400, seed=0):
    rng = np.random.default_rng(seed)
    out = ["".join(rng.choice(list(letters), rng.integers(0, longest))) for _ in range(n)]
    for _ in range(n):  # shared passages at other places
        i, j = rng.integers(0, n, 2)
        a = out[i]
        if len(a) > 10:
            s = int(rng.integers(0, len(a) // 2))
            cut = int(rng.integers(0, len(out[j]) + 1))
            out[j] = out[j][:cut] + a[s : s + 250] + out[j][cut:]
    return out


@pytest.mark.parametrize("length", [1, 2, 3, 10, 20, 24, 77, 100])
def test_rolling_names_tell_windows_apart(length):
    x = RNG.integers(0, 3, 500).astype(np.uint64)
    names = common.rolling(x, length)
    windows = [x[i : i + length].tobytes() for i in range(501 - length)]
    assert len(names) == len(windows)
    assert len(set(zip(windows, names.tolist(), strict=True))) == len(set(windows)) == len(set(names.tolist()))


def test_words_split_at_ascii_white_space_only():
    assert common.words("A\x0bb c\x1cd\x85 É\t\r\n", lower=True) == ["a".encode(), "b".encode(), "c\x1cd\x85".encode(), "É".encode()]
    assert common.words(None) == common.words(" \n") == []


def test_fingerprint_bits():
    for text in ["", "one", "One two", "a b c a b c a b c d", "x " * 50 + "y"]:
        w = text.lower().split()
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_every_close_pair_shares_a_mask():
    masks = simhash.split_bits(0, 6, 3)
    assert len(masks) == 20
    for _ in range(300):
        flip = sum(1 << int(b) for b in RNG.choice(64, 3, replace=False))
        assert any(not flip & m for m in masks)
        wider = simhash.split_bits(masks[4], 6, 3)
        assert flip & masks[4] or any(not flip & m for m in wider)


def test_search_inside_a_bucket_keeps_every_connection():
    fps = np.concatenate([RNG.integers(0, 2**63, 5)[:, None] ^ (1 << RNG.integers(0, 62, (5, 30))) ^ (1 << RNG.integers(0, 62, (5, 30)))]).ravel()
    a, b = simhash.linked_inside(fps, 3)

    def groups(pairs):
        up = {int(f): int(f) for f in fps}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in pairs:
            up[max(top(x), top(y))] = min(top(x), top(y))
        return {f: top(f) for f in up}

    every = [(int(x), int(y)) for x in fps for y in fps if x < y and int(x ^ y).bit_count() <= 3]
    assert groups(zip(a.tolist(), b.tolist(), strict=True)) == groups(every)


def as_block(texts, first=0):
    return pa.table({"doc": pa.array(range(first, first + len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def exchange(parts, reducer):
    """What the shuffle by bucket does."""
    rows = pa.concat_tables(parts)
    out = [reducer((b,), rows.filter(pa.compute.equal(rows.column("bucket"), b))) for b in pa.compute.unique(rows.column("bucket"))] if rows.num_rows else []
    return pa.concat_tables(out) if out else pa.table({"block": pa.array([], pa.int64()), "step": pa.array([], pa.int32()), "bucket": pa.array([], pa.int64()), "answer": pa.array([], pa.binary())})


def own(rows, block):
    return rows.filter(pa.compute.equal(rows.column("block"), block))


@pytest.mark.parametrize("seed", range(4))
def test_repeated_bytes_against_brute_force(seed, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 128)
    window, anchor = 30, 7
    texts = [*some_texts(24, seed=seed), "a" * 200, "", "ab" * 90, None, "a" * 29]
    cut = [texts[:7], texts[7:8], texts[8:20], texts[20:]]
    made = [suffixes.ByteBlock(as_block(t), window, anchor, 5) for t in cut]
    one = exchange([blocks.entries(i, m.bucket, m.distinct) for i, m in enumerate(made)], suffixes.judge)
    for i, m in enumerate(made):
        m.refine(blocks.answered(own(one, i), 1))
    two = exchange([blocks.entries(i, m.bucket2, m.names) for i, m in enumerate(made)], blocks.in_earlier_block(2))
    got = b"".join(m.removed(blocks.answered(own(two, i), 2)).astype(np.uint8).tobytes() for i, m in enumerate(made))
    seen, want = set(), b""
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if data[p : p + window] in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(data[p : p + window])
        want += bytes(gone)
    assert got == want and sum(want) > 0


@pytest.mark.parametrize("seed", range(4))
def test_repeated_words_against_brute_force(seed):
    window = 8
    texts = [*some_texts(30, letters="a b c ", longest=200, seed=seed), "a " * 60, "", None, "b"]
    cut = [texts[:9], texts[9:10], texts[10:]]
    made = [anchors.WordBlock(as_block(t), window, 3) for t in cut]
    one = exchange([m.first_entries(i) for i, m in enumerate(made)], anchors.hits)
    for i, m in enumerate(made):
        m.extend(blocks.answered(own(one, i), 1).astype(bool))
    two = exchange([blocks.entries(i, m.bucket, m.full) for i, m in enumerate(made)], blocks.in_earlier_block(2))
    got = [g for i, m in enumerate(made) for g in m.removed(blocks.answered(own(two, i), 2)).tolist()]
    seen, want = set(), []
    for t in texts:
        w = (t or "").split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        want += gone
    assert got == want and any(want)


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    code, plain = tokens.Encoder(tokens.token_path()), Tokenizer.from_file(tokens.token_path())
    texts = ["", None, "  a", " a b ", "a  b", "a\n\nb c", "x \n y", "<|endoftext|> a<|endoftext|>b", "it's a 's ' s don't.", "a　b c", "a\x1cb \x1c c", "1 2 3,000\t\tz", "é ñ\r\nb", "\n", "word, word. word", "日本語 text", "a_b #x *** y%%%", "²³ ½"]
    texts += some_texts(20, letters="ab ,.'\n\té1")
    for data, text in zip(code.encode(texts), texts, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


ODD = ["", None, "  a", " a b ", " ", "a  b", "a\n\nb c", "x \n y", "<|endoftext|> a<|endoftext|>b", "<|endo", "ftext|> a b", "it's a 's ' s don't.", "l'eau,l'Été d''été 5's 'll'm.'s", "a\u3000b c", "a\x1cb \x1c c", "a \xa0 b\u2003 c\x85d \u2028e",
    "1 2 3,000\t\tz", "é ñ\r\nb", "\n", "\nword, word. word\n", "日本語 text。x", "a_b #x *** y%%%", "²³ ½a1 x2y", "3×4÷5 ×é.÷", "Привет,мир! ё1҂ Ѐ.", "e\u0301.a \u0301,", "“quoted”–λόγος. ªº. ß5"]


def test_columns_of_tokens_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.token_path())
    texts = ODD + some_texts(60, letters="ab ,.'\"(\n\té1÷×Ж’\xa0λ\u0301日")
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    for part, known, longest in ((8 << 20, 500_000, 64), (300, 20, 64), (1, 1, 2)):
        monkeypatch.setattr(tokens, "PART_BYTES", part)
        monkeypatch.setattr(tokens, "KNOWN", known)
        monkeypatch.setattr(tokens, "KNOWN_BYTES", longest)
        code = tokens.Encoder(tokens.token_path())
        for kind in (pa.string(), pa.large_string()):
            got = list(code.encode_column(pa.array(["before", *texts, "after"], kind).slice(1, len(texts)), 7))
            assert np.concatenate([n for _, n in got]).tolist() == [len(w) for w in want]
            assert np.concatenate([ids for ids, _ in got]).tolist() == [i for w in want for i in w]
            assert len(code.known.names) <= known
            assert len(got) == 1 if part > 1 << 20 else len(got) > 5
    assert list(code.encode_column(pa.array([], pa.string()), 7)) == []
    assert [(i.tolist(), n.tolist()) for i, n in code.encode_column(pa.array(["", None]), 7)] == [([7, 7], [1, 1])]


def test_columns_spell_each_piece_once(monkeypatch):
    """Words with other marks behind them, in many texts, cost one call of the tokenizer a word."""
    made = []
    make = tokens.Pieces.make
    monkeypatch.setattr(tokens.Pieces, "make", lambda self, piece: made.append(piece) or make(self, piece))
    code = tokens.Encoder(tokens.token_path())
    texts = [" ".join(["x", *(w + m for w in ("aval", "bevel", "été"))]) for m in (",", ".", "!", ")", "%%%", "5", "") for _ in range(50)]
    for _ in range(2):
        list(code.encode_column(pa.array(texts), 2))
    assert sorted(made) == sorted(["x", "aval", "bevel", "été", ",", ".", "!", ")", "%%%", "5"])


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    code = tokens.Encoder(tokens.token_path())
    texts = [" ".join("wxyz"[i % 4] * (1 + i // 4) + "a." for i in range(k, k + 4)) for k in range(12)]
    assert code.encode(texts) == [code.whole(t) for t in texts] == [code.encode([t])[0] for t in texts]


@pytest.mark.parametrize(("n", "kinds"), [(0, 5), (1, 1), (512, 2), (700, 3), (5000, 300)])
def test_wavelet_shard_answers(n, kinds):
    ids = (RNG.zipf(1.3, n) % kinds).astype(np.uint32) * 7
    shard = wavelet.Shard(wavelet.encode([1, None], np.array([n, 0]), ids))
    assert shard.docs == [1, None] and (shard.decode() == ids).all()
    at = RNG.integers(0, n, 100) if n else np.zeros(0, int)
    assert (shard.access(at) == ids[at]).all()
    for token in [*set(ids.tolist())][:10] + [99999]:
        a, b = sorted(RNG.integers(0, n + 1, 2).tolist())
        assert shard.count(token, a, b) == int((ids[a:b] == token).sum())
        assert (shard.find(token, a, b) == np.flatnonzero(ids[a:b] == token) + a).all()


def test_pieces_are_full_but_the_first():
    for n in (1, 5, 6, 10, 11, 23):
        cut = packing.piece_bounds(n, 5)
        assert len(cut) == math.ceil(n / 5) and sum(k for _, k in cut) == n and all(k == 5 for _, k in cut[1:])
        assert [s for s, _ in cut] == [sum(k for _, k in cut[:i]) for i in range(len(cut))]


def test_evolution_packs_every_piece_once_and_well():
    lengths = np.concatenate([RNG.integers(1, 2049, 600), [2048] * 5, RNG.integers(1, 60, 300)])
    at = packing.evolve(lengths, [], 3, 2048)
    again = packing.evolve(lengths, [at, packing.evolve(lengths, [], 4, 2048)], 5, 2048)
    for x in (at, again):
        assert np.bincount(x, lengths).max() <= 2048 and len(x) == len(lengths)
        assert int(x.max()) + 1 <= math.ceil(1.02 * lengths.sum() / 2048)
    assert again.max() <= at.max()
    child = packing.cross(lengths[:500], *(packing.compact(RNG.permutation(500)) for _ in range(2)), 2048, RNG)
    assert np.bincount(child, lengths[:500]).max() <= 2048


def test_equal_substrings_share_phrases():
    letters = np.array(list("abcdefgh "))
    core = "".join(RNG.choice(letters, 3000))
    a, b, c = ("".join(RNG.choice(letters, n)) + core + "".join(RNG.choice(letters, n)) for n in (7, 130, 31))
    other = "".join(RNG.choice(letters, 3000))
    places, whole = parsing.fingerprints([a, b, c, other, a, "", "", "x", "xx", "a" * 5000])
    assert parsing.likeness(places[0], places[1]) > 0.7 and parsing.likeness(places[1], places[2]) > 0.7
    assert parsing.likeness(places[0], places[3]) < 0.1 and parsing.likeness(places[5], places[6]) == 1
    text = parsing.as_text(places, whole)
    assert text[0] == text[4] and len(set(text)) == 8
    alone = parsing.as_text(*parsing.fingerprints([b]))[0]
    assert alone == text[1]  # what a text is parsed with makes no difference


def test_edited_text():
    assert parsing.edited("abcdefgh", "XY") == "abcdefXY" and parsing.edited("abcdefgh", "X") == "abcdefX" and parsing.edited("abc", "X") == "abc"


def test_language_model_learns_and_abstains():
    made = {"aa": "alba tora ", "bb": "zwük ßtra "}
    rng = np.random.default_rng(1)
    texts = [("".join(rng.choice(made[k].split(" ")[:2], 20)) + " ", k) for k in made for _ in range(30)]
    model = langid.Model([k for _, k in texts], [langid.presence(t) for t, _ in texts])
    got = model.predict(["alba alba", "ZWÜK", None, "", "12 !?"])
    assert [g[0] for g in got] == ["aa", "bb", "und", "und", "und"] and all(0 <= g[1] <= 1 for g in got)


def test_long_text_is_seen_whole(monkeypatch):
    text = "".join(RNG.choice(list("abc de"), 1000))
    want = langid.presence(text)
    monkeypatch.setattr(langid, "CHUNK", 64)
    got = langid.presence(text)
    assert set(want.tolist()) <= set(got.tolist()) and len(got) <= len(want) + 40


def test_label_model_finds_the_better_labellers():
    n = len(quality.LABELLERS)
    truth = RNG.uniform(size=20000) < 0.8
    right = np.array([0.95] * 4 + [0.6] * (n - 4))
    votes = np.where((RNG.uniform(size=(20000, n)) < right) == truth[:, None], 1, -1)
    codes, counts = np.unique(((votes + 1) * 3 ** np.arange(n - 1, -1, -1)).sum(axis=1), return_counts=True)
    good, accuracy, share = quality.weak_labels(codes, counts)
    assert abs(share - 0.8) < 0.02 and (np.abs(accuracy[:, 0] - right) < 0.05).all()
    assert (quality.unpack(codes) == np.stack([codes // 3 ** (n - 1 - j) % 3 - 1 for j in range(n)], axis=1)).all()


def test_scorer_follows_its_targets():
    texts = ["plain words of a text that goes on " * 3, "b%%% c### d$$$ e&&& " * 5] * 30
    signs = [quality.Signs(t) for t in texts]
    scorer = quality.Scorer([quality.features(s) for s in signs], np.array([1.0, 0.0] * 30))
    assert scorer.score(signs[0]) > 0.8 and scorer.score(signs[1]) < 0.2 and scorer.score(quality.Signs(" \n")) == scorer.score(quality.Signs(None)) == 0


def test_sketch_of_a_class_finds_every_contained_item():
    for n in range(1, 200):
        k = decontam.sketch_size(n, 0.8)
        assert min(n, n - math.ceil(0.8 * n - 1e-9) + 1) <= k <= n
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[100:130])
    length, names = decontam.item_shingles(item)
    items = decontam.Items([(7, length, names.tobytes()), (8, *(lambda x: (x[0], x[1].tobytes()))(decontam.item_shingles("w5 w6")))], 0.8)
    changed = [*words[:129], "x", *words[130:]]
    assert sorted(h[0] for h in items.find(" ".join(words))) == [0, 1]
    assert (0, 25, 26) in items.find(" ".join(changed)) and items.find("nothing here") == [] and items.find(None) == []


def test_sliding_minimum_and_runs():
    x = RNG.integers(0, 1000, 300).astype(np.uint64)
    for w in (1, 2, 3, 64, 77):
        assert suffixes.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(301 - w)]
    assert [a.tolist() for a in blocks.runs(np.array([True, True, False, True]))] == [[0, 3], [2, 1]]
    assert [a.tolist() for a in blocks.runs(np.zeros(0, bool))] == [[], []]




def test_set_fingerprints_and_wide_sketches():
    assert simhash.set_fingerprint(np.zeros(0, np.uint64)) == 0
    for n in (1, 2, 7, 90, 1500):
        x = np.unique(RNG.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        assert simhash.set_fingerprint(x) == sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x) > len(x))
        for m in (1, 40, 2 * n):
            y = np.unique(np.r_[x[: n // 2], RNG.integers(0, 2**63, m).astype(np.uint64)])
            only = len(np.setxor1d(x, y))
            assert simhash.wide_apart(simhash.wide_sketch(x), simhash.wide_sketch(y)) <= only
    a, b = (RNG.integers(0, 2**63, 4000).astype(np.uint64) for _ in "ab")
    assert simhash.wide_apart(simhash.wide_sketch(a), simhash.wide_sketch(b)) > 8000 / 9  # long texts that share nothing are ruled out


def test_a_pair_is_named_by_the_first_large_bucket_that_it_shares():
    keys, members = list(range(10, 60)), 40
    search = simhash.candidates_inside(0.8)
    named = []
    for at, key in enumerate(keys):
        earlier = [keys[at - i - 1] if at > i else key for i in range(simhash.BACK)]
        columns = {"node": np.arange(members), "root": np.arange(members), "size": np.full(members, 100), "part": np.zeros(members, np.int64)}
        columns |= {f"w{i}": np.zeros(members, np.int64) for i in range(simhash.WORDS)} | {f"p{i}": np.full(members, p) for i, p in enumerate(earlier)}
        got = search((pa.scalar(key), pa.scalar(0), pa.scalar(0)), pa.table({c: v.astype(np.int64) for c, v in columns.items()}))
        named += list(zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True))
    assert sorted(named) == [(a, b) for a in range(members) for b in range(a + 1, members)]


def test_freed_memory_goes_back_to_the_system():
    def held():
        with open("/proc/self/status") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("VmRSS"))

    pieces = [bytes(2000) for _ in range(50_000)]
    last = bytes(2000)  # keeps the C library from cutting its heap there
    del pieces
    before = held()
    common.give_back()
    assert before - held() > 50_000 and len(last) == 2000


def test_a_stream_of_batches_ends_with_giving_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"a": [1, 2]})
    assert list(common.per_batch(lambda b: b)(iter([batch, batch]))) == [batch, batch] and calls == [1]
