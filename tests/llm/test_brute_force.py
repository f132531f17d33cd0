"""The fitted label model, the string kernel and the parsing against plain versions made from their descriptions."""

import math
import random

import numpy as np
import pytest

from sparkmetrica.llm import langid, parsing, quality
from sparkmetrica.llm.common import mix

# --- label model


def chances(votes, weight, good):
    """Chances of each vote by class and labeller, counted one pattern at a time; the few thousandths of prior votes as documented."""
    out = {}
    for kind, prior in (("bad", (0.6, 0.3, 0.1)), ("good", (0.05, 0.3, 0.65))):
        for j in range(len(votes[0])):
            seen = [0.002 * p for p in prior]
            for pattern, w, g in zip(votes, weight, good, strict=True):
                seen[pattern[j] + 1] += w * (g if kind == "good" else 1 - g)
            out[kind, j] = [s / sum(seen) for s in seen]
    return out


def likelihoods(votes, share, chance):
    both = []
    for pattern in votes:
        a, b = share, 1 - share
        for j, v in enumerate(pattern):
            a, b = a * chance["good", j][v + 1], b * chance["bad", j][v + 1]
        both.append((a, b))
    return both


def objective(votes, weight, share, chance):
    fit = sum(w * math.log(a + b) for w, (a, b) in zip(weight, likelihoods(votes, share, chance), strict=True))
    for (kind, _), c in chance.items():
        fit += sum(0.002 * p * math.log(x) for p, x in zip((0.6, 0.3, 0.1) if kind == "bad" else (0.05, 0.3, 0.65), c, strict=True))
    return fit


@pytest.fixture
def four_labellers(monkeypatch):
    monkeypatch.setattr(quality, "LABELLERS", {k: None for k in "abcd"})
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):  # labellers of unlike accuracy, who abstain at times
        good = rng.random() < 0.7
        votes = tuple(0 if rng.random() < quiet else (1 if good == (rng.random() < right) else -1) for right, quiet in ((0.95, 0.1), (0.85, 0.3), (0.8, 0.0), (0.7, 0.5)))
        code = sum((v + 1) * 3 ** (3 - j) for j, v in enumerate(votes))
        counts[code] = counts.get(code, 0) + 1
    codes = np.array(sorted(counts), np.int64)
    return codes, np.array([counts[c] for c in codes.tolist()], float)


def test_patterns_unpack_to_their_votes(four_labellers):
    codes, _ = four_labellers
    assert [[c // 27 - 1, c // 9 % 3 - 1, c // 3 % 3 - 1, c % 3 - 1] for c in codes.tolist()] == quality.unpack(codes).tolist()


def test_posteriors_are_those_of_the_likelihood(four_labellers):
    codes, counts = four_labellers
    good, right, share = quality.weak_labels(codes, counts)
    votes, weight = [tuple(v) for v in quality.unpack(codes).tolist()], (counts / counts.sum()).tolist()
    chance = chances(votes, weight, good.tolist())
    mine = sum(w * g for w, g in zip(weight, good.tolist(), strict=True))
    assert share == pytest.approx(mine, abs=1e-6)
    for got, (a, b) in zip(good.tolist(), likelihoods(votes, mine, chance), strict=True):
        assert got == pytest.approx(a / (a + b), abs=1e-6)
    for j in range(4):
        assert right[j, 0] == pytest.approx(chance["good", j][2] / (chance["good", j][2] + chance["good", j][0]), abs=1e-6)


def test_no_model_nearby_is_more_likely(four_labellers):
    codes, counts = four_labellers
    good, _, _ = quality.weak_labels(codes, counts)
    votes, weight = [tuple(v) for v in quality.unpack(codes).tolist()], (counts / counts.sum()).tolist()
    chance = chances(votes, weight, good.tolist())
    share = sum(w * g for w, g in zip(weight, good.tolist(), strict=True))
    best, rng = objective(votes, weight, share, chance), random.Random(1)
    for k in range(300):
        size = 10 ** -(1 + k % 4)
        other = {key: [x * math.exp(size * rng.gauss(0, 1)) for x in c] for key, c in chance.items()}
        other = {key: [x / sum(c) for x in c] for key, c in other.items()}
        odds = share / (1 - share) * math.exp(size * rng.gauss(0, 1))
        assert objective(votes, weight, odds / (1 + odds), other) <= best + 1e-9


# --- string kernel


def grams(text):
    """Distinct n-grams of one to three letters, all but letters as one space."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in letters:
        letters = letters.replace("  ", " ")
    return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}


TEXTS = [
    ("the cat sat on the mat, and the dog ran", "en"), ("where is the house of the old man?", "en"), ("this is what they had said to him", "en"), ("a ship sails over the wide sea", "en"),
    ("le chat est sur la table et le chien court", "fr"), ("où est la maison du vieil homme?", "fr"), ("voilà ce qu'ils lui avaient dit", "fr"), ("un navire vogue sur la mer", "fr"),
    ("die Katze saß auf der Matte - der Hund lief", "de"), ("wo ist das Haus des alten Mannes?", "de"), ("das hatten sie ihm gesagt", "de"), ("ein Schiff fährt über das weite Meer", "de"),
]


def test_kernel_counts_shared_grams():
    rows = langid.unit_rows([langid.presence(t) for t, _ in TEXTS]).astype(float)
    for i, (a, _) in enumerate(TEXTS):
        for j, (b, _) in enumerate(TEXTS):
            want = len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
            assert rows[i] @ rows[j] == pytest.approx(want, abs=0.03)  # a few n-grams fall on one place


def test_runs_of_other_characters_are_one_space_across_chunks(monkeypatch):
    text = "one  two" + " " * 9 + "three, 123456 four" + "." * 20 + "five"
    whole = langid.presence(text).tolist()
    assert len(whole) == pytest.approx(len(grams(text)), abs=2)
    for chunk in range(1, 30):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert langid.presence(text).tolist() == whole


def test_scores_solve_the_ridge_problem():
    model = langid.Model([k for _, k in TEXTS], [langid.presence(t) for t, _ in TEXTS])
    rows = langid.unit_rows([langid.presence(t) for t, _ in TEXTS]).astype(float)
    kernel, target = rows @ rows.T, np.array([[1.0 if k == lang else -1.0 for lang in ("de", "en", "fr")] for _, k in TEXTS])
    # fewer texts than landmarks, so all are landmarks: ridge regression by least squares on stacked equations
    n = len(TEXTS)
    root = np.linalg.cholesky(langid.RIDGE * n * kernel + 1e-9 * n * np.eye(n)).T
    dual = np.linalg.lstsq(np.vstack([kernel, root]), np.vstack([target, np.zeros((n, 3))]), rcond=None)[0]
    new = ["the old dog is at sea", "la mer et le chat", "der alte Hund", ""]
    for text, (lang, score) in zip(new, model.predict(new), strict=True):
        if not text:
            assert (lang, score) == ("und", 0.0)
            continue
        raw = [4 * sum(float(langid.unit_rows([langid.presence(text)])[0] @ rows[i]) * dual[i, k] for i in range(n)) for k in range(3)]
        odds = [math.exp(x) for x in raw]
        assert lang == ("de", "en", "fr")[raw.index(max(raw))] and score == pytest.approx(max(odds) / sum(odds), abs=1e-3)


# --- locally consistent parsing


def plain_phrases(names):
    """Phrases of one text as tuples of symbols, runs being one symbol."""
    symbols, i = [], 0
    while i < len(names):
        j = i
        while j < len(names) and names[j] == names[i]:
            j += 1
        run = np.array([(names[i] + (j - i) * 0x9E3779B97F4A7C15) % 2**64], np.uint64)
        symbols.append(names[i] if j - i == 1 else int(mix(run)[0]))
        i = j
    labels = symbols
    for _ in range(4):
        tossed = []
        for i, x in enumerate(labels):
            bit = 0
            while i and x >> bit & 1 == labels[i - 1] >> bit & 1:
                bit += 1
            tossed.append(2 * bit + (x >> bit & 1))
        labels = tossed
    assert all(a != b for a, b in zip(labels, labels[1:], strict=False))
    starts = [0, *(i for i in range(2, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1])]
    return [tuple(symbols[a:b]) for a, b in zip(starts, [*starts[1:], len(symbols)], strict=True)]


def some_texts():
    rng = random.Random(11)
    out = ["".join(rng.choice("abcde fgh") for _ in range(rng.randint(1, 600))) for _ in range(12)]
    return [*out, out[0][:200] + out[1], "x" * 300, "ab" * 150, "a", "ab", "aab", out[2] * 2, "é😀" * 40 + out[3]]


def levels(text):
    """Names of every level, each level's phrases checked against the plain ones."""
    names, level, out = np.array([ord(c) + 1 for c in text], np.uint64), 0, []
    while True:
        level += 1
        want = plain_phrases(names.tolist())
        names, seg = parsing.parse_level(names, np.zeros(len(names), np.int64), level)
        assert len(names) == len(want) == len(seg)
        assert len(set(zip(names.tolist(), want, strict=True))) == len(set(names.tolist())) == len(set(want))
        out.append(names.tolist())
        if len(names) == 1:
            return out


def kept(text):
    """All names a fingerprint is drawn from: of the second level and above, and of the whole text."""
    found = levels(text) if text else []
    return {n for k, names in enumerate(found, 1) for n in names if k >= 2 or len(names) == 1}


def test_fingerprints_are_the_least_names():
    texts = ["", *some_texts()]
    places, _ = parsing.fingerprints(texts)
    for text, row in zip(texts, places.tolist(), strict=True):
        want = [0xFFFF] * parsing.PLACES
        for p in range(parsing.PLACES):
            mine = [n >> 6 for n in kept(text) if n & 63 == p]
            if mine:
                want[p] = min(mine) & 0xFFFF
                want[p] = 0 if want[p] == 0xFFFF else want[p]
        assert row == want


def test_likeness_is_near_the_jaccard_similarity_of_the_names():
    texts = [t for t in some_texts() if len(t) > 250]
    off = []
    for i, a in enumerate(texts):
        for b in texts[i:]:
            row = parsing.fingerprints([a, b])[0]
            exact = len(kept(a) & kept(b)) / len(kept(a) | kept(b))
            filled = [p for p in range(parsing.PLACES) if row[0][p] != 0xFFFF or row[1][p] != 0xFFFF]
            got = float(parsing.likeness(row[0], row[1]))
            assert got == pytest.approx(sum(row[0][p] == row[1][p] for p in filled) / len(filled))
            off.append(abs(got - exact))
    assert max(off) < 0.3 and sum(off) / len(off) < 0.08
