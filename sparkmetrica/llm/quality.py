"""Quality classifier from weak labels, without any labelled text.

Heuristic labellers look at every document and vote good, bad or nothing. Expectation-maximisation over the counts of all
vote patterns (there are at most ``3 ** labellers``) estimates how often each labeller is right on good
and on bad documents; the posterior of a document's pattern is its weak label. A linear scorer on hashed
features is then trained on the posteriors of a bounded sample and scores every document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmetrica.llm.common import U, give_back, mix, words
from sparkmetrica.session import settle

PLACES = 1 << 12  # hashed features
TRAIN = 6000  # documents the scorer is trained on, at most
GRAMS = (1, 2, 3)
CHUNK = 1 << 18  # characters looked at once
KEEP = 0.5

# Character classes: other, space, lower case or caseless letter, upper case, digit, sentence mark, symbol, line end.
OTHER, SPACE, LOWER, UPPER, DIGIT, MARK, SYMBOL, LINE = range(8)
_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _CLASS:
        def kind(c: str) -> int:
            if c == "\n":
                return LINE
            if c.isspace():
                return SPACE
            if c.isupper():
                return UPPER
            if c.isalpha():
                return LOWER
            if c.isdigit():
                return DIGIT
            if c in ".,;:?!'\"()-–—‘’“”«»¿¡、。":
                return MARK
            return SYMBOL if c.isprintable() else OTHER

        _CLASS.append(np.fromiter((kind(chr(c)) for c in range(0x110000)), np.uint8, 0x110000))
    return _CLASS[0]


class Signs:
    """What the labellers and the scorer see of one whole text."""

    def __init__(self, text: str | None):
        text = text or ""
        count = np.zeros(8, np.int64)
        self.grams = np.zeros((len(GRAMS), PLACES), np.int32)
        symbol_runs = 0
        for at in range(0, len(text), CHUNK):
            kind = classes()[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")]
            count += np.bincount(kind, minlength=8)
            shape = kind[np.r_[True, kind[1:] != kind[:-1]]].astype(np.uint64)  # runs of one class as one
            symbol_runs += int((shape == SYMBOL).sum())
            for row, n in enumerate(GRAMS):
                if len(shape) >= n:
                    gram = np.full(len(shape) - n + 1, n, np.uint64)
                    for i in range(n):
                        gram = (gram << U(3)) | shape[i : len(shape) - n + 1 + i]
                    self.grams[row] += np.bincount((mix(gram) & U(PLACES - 1)).astype(np.int64), minlength=PLACES).astype(np.int32)
        found = words(text)
        self.n = len(found)
        self.chars = int(count.sum() - count[SPACE] - count[LINE])
        letters = int(count[LOWER] + count[UPPER])
        share = lambda a, b: a / b if b else 0.0
        self.symbols = share(int(count[SYMBOL] + count[OTHER]), self.chars)
        self.marks = share(int(count[MARK]), self.chars)
        self.upper = share(int(count[UPPER]), letters)
        self.letters = share(letters + int(count[DIGIT]), self.chars)
        self.cries = share(text.count("!"), self.n)
        self.runs = share(symbol_runs, self.n)
        self.twice = share(sum(map(bytes.__eq__, found[1:], found)), self.n)
        kinds = len(set(found))
        self.variety = share(kinds, self.n ** 0.8) if self.n else 0.0
        self.distinct = share(kinds, self.n)
        self.length = share(self.chars, self.n)


#: name: votes bad (-1), good (1) or nothing (0) on the signs of a text
LABELLERS = {
    "symbols": lambda s: -1 if s.symbols > 0.06 else 1,
    "symbol_runs": lambda s: -1 if s.runs > 0.2 else 1,
    "letters": lambda s: -1 if s.letters < 0.6 else 1,
    "capitals": lambda s: -1 if s.upper > 0.5 and s.n >= 5 else 1,
    "cries": lambda s: -1 if s.cries > 0.3 and s.n >= 5 else 1,
    "marks": lambda s: -1 if s.marks > 0.15 and s.n >= 5 else 1,
    "repeats": lambda s: -1 if s.twice > 0.3 and s.n >= 5 else 1,
    "variety": lambda s: -1 if s.distinct < 0.3 and s.variety < 1.0 and s.n >= 20 else 1,
    "length": lambda s: -1 if s.n == 0 or s.length > 20 else 1,
}


def pattern(s: Signs) -> int:
    """The votes of all labellers as one number, a digit to the base 3 for each."""
    code = 0
    for vote in LABELLERS.values():
        code = 3 * code + vote(s) + 1
    return code


def unpack(codes: np.ndarray) -> np.ndarray:
    n = len(LABELLERS)
    return np.stack([codes // 3 ** (n - 1 - j) % 3 - 1 for j in range(n)], axis=1) if len(codes) else np.zeros((0, n), np.int64)


def weak_labels(codes: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, accuracies (good, bad) per labeller, share of good), by expectation-maximisation.

    Each labeller has its own three chances of a vote on good and on bad documents; silence is a vote, as many only
    ever speak up about one class. A few thousandths of the documents count as agreeing, so that no chance is 0.
    """
    votes = unpack(codes)
    if not len(votes):
        return np.zeros(0), np.full((len(LABELLERS), 2), 0.5), 0.5
    said = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, labeller, vote
    weight = counts / counts.sum()
    good = np.where((votes < 0).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        share = float((weight * good).sum())
        chance = []
        for g, prior in ((1 - good, (0.6, 0.3, 0.1)), (good, (0.05, 0.3, 0.65))):
            seen = np.einsum("p,pjv->jv", weight * g, said) + 0.002 * np.array(prior)
            chance.append(seen / seen.sum(axis=1, keepdims=True))
        share = min(max(share, 1e-4), 1 - 1e-4)
        odds = math.log(share / (1 - share)) + np.einsum("pjv,jv->p", said, np.log(chance[1]) - np.log(chance[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = float(np.abs(new - good).max()) < tolerance
        good = new
        if done:
            break
    right = np.stack([chance[1][:, 2] / (chance[1][:, 2] + chance[1][:, 0]), chance[0][:, 0] / (chance[0][:, 0] + chance[0][:, 2])], axis=1)
    return good, right, share


def features(s: Signs) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: square roots of the shares of the character-class n-grams, and ranges of word repetition."""
    out = np.zeros(PLACES, np.float32)
    for row, n in zip(s.grams, GRAMS, strict=True):
        if row.any():
            out += np.sqrt(row / row.sum()).astype(np.float32) * (2.0 if n == 1 else 1.0)
    if s.n:
        size = min(int(math.log2(s.n)), 12)
        tokens = [("twice", int(10 * s.twice)), ("distinct", int(10 * s.distinct), size // 2), ("variety", min(int(4 * s.variety), 12)), ("symbols", int(20 * s.symbols)),
                  ("upper", int(10 * s.upper)), ("cries", min(int(4 * s.cries), 8)), ("length", min(int(s.length), 20)), ("size", size)]
        for t in tokens:
            out[xxhash.xxh3_64_intdigest("/".join(map(str, t))) & (PLACES - 1)] += 1.0
    at = np.flatnonzero(out)
    return at.astype(np.uint16), out[at]


class Scorer:
    """Logistic scorer on the hashed features, trained on weak labels by adaptive gradient steps over the whole sample."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, ridge: float = 1e-4, steps: int = 400):
        self.weights, self.bias = np.zeros(PLACES), 0.0
        if not rows:
            return
        place = np.concatenate([r[0] for r in rows]).astype(np.int64)
        value = np.concatenate([r[1] for r in rows]).astype(np.float64)
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        n = len(rows)
        # both classes count alike, so rare bad documents are learned as well
        weight = np.where(target > 0.5, 0.5 / max(target.sum(), 1e-9), 0.5 / max((1 - target).sum(), 1e-9)) * n
        w, b, m, v = np.zeros(PLACES), 0.0, np.zeros(PLACES + 1), np.zeros(PLACES + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[place], n) + b, -40, 40)))
            err = weight * (p - target) / n
            grad = np.r_[np.bincount(place, value * err[owner], PLACES) + ridge * w, err.sum()]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            w, b = w - step[:-1], b - float(step[-1])
        self.weights, self.bias = w, b

    def score(self, s: Signs) -> float:
        """Chance that the document is good; 0 for a text without any character but white space."""
        if s.chars == 0:
            return 0.0
        at, value = features(s)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ value + self.bias, -40, 40))))


class Quality:
    """The fitted label model and scorer."""

    def __init__(self, codes, posterior, accuracies, share, scorer):
        self.posterior = dict(zip(codes.tolist(), posterior.tolist(), strict=True))
        self.accuracies = dict(zip(LABELLERS, accuracies.tolist(), strict=True))
        self.share, self.scorer = share, scorer

    def judge(self, text: str | None) -> tuple[float, float]:
        s = Signs(text)
        return self.posterior.get(pattern(s), self.share), self.scorer.score(s)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Quality:
    """Label model over the votes on all documents, scorer on a sample of ``TRAIN`` of them at most, those of the smallest hashes of id and text."""
    rate = min(1.0, TRAIN / max(1, docs.count()))
    rate = min(1.0, 1.2 * rate)  # some to spare; the smallest hashes are taken of these
    schema = "code int, drawn long, place binary, value binary"

    def run(batches):
        for batch in batches:
            codes, places, values = [], [], []
            for text, picked in zip(batch.column("text"), batch.column("picked").to_pylist(), strict=True):
                s = Signs(text.as_py())
                codes.append(pattern(s))
                at, value = features(s) if picked else (None, None)
                places.append(at.tobytes() if picked else None)
                values.append(value.tobytes() if picked else None)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), batch.column("drawn"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["code", "drawn", "place", "value"])
        give_back()

    drawn = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7)), F.lit(1 << 40))
    seen = settle(docs.select(F.col(text_col).alias("text"), drawn.alias("drawn"), (drawn < rate * (1 << 40)).alias("picked")).mapInArrow(run, schema))
    counts = sorted((r[0], r[1]) for r in seen.groupBy("code").count().collect())
    codes, n = np.array([c for c, _ in counts], np.int64), np.array([k for _, k in counts], np.float64)
    posterior, accuracies, share = weak_labels(codes, n)
    label = dict(zip(codes.tolist(), posterior.tolist(), strict=True))
    least = seen.where("place IS NOT NULL").orderBy("drawn", "place", "value").limit(TRAIN)
    sample = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in least.select("code", "place", "value").collect())
    rows = [(np.frombuffer(p, np.uint16), np.frombuffer(v, np.float32)) for _, p, v in sample]
    scorer = Scorer(rows, np.array([label[c] for c, _, _ in sample]))
    return Quality(codes, posterior, accuracies, share, scorer)


def score(docs: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``(id, weak_label, score, keep)`` for every row; NULL, empty and blank texts have score 0 and are not kept. Repeated rows get equal answers."""

    def run(batches):
        for batch in batches:
            found = [model.judge(t.as_py()) for t in batch.column("text")]
            score = [f[1] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([f[0] for f in found], pa.float64()), pa.array(score, pa.float64()), pa.array([s >= keep for s in score])], ["id", "weak_label", "score", "keep"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, weak_label double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Quality, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` without the rows that score below ``keep``; all columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([model.judge(t.as_py())[1] >= keep for t in batch.column(at)], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
