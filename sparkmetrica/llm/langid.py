"""Language identification by a string kernel with Nyström landmarks.

The feature of a text is the presence of its character n-grams of one to three letters
(blended spectrum), hashed to ``2**BITS`` places; the kernel of two texts is the number of
shared n-grams over the geometric mean of their numbers. One-versus-rest kernel ridge
regression is fitted on kernels to landmark texts. Scores of a batch of texts are one product of their
presence matrix with (landmarks' presence) x (coefficients).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmetrica.llm.common import U, mix
from sparkmetrica.session import settle

BITS = 14
ORDERS = (1, 2, 3)
SAMPLE = 2400  # texts learned from, shared out evenly among the languages, at least SAMPLE_LEAST each
SAMPLE_LEAST = 20
SLOTS = 1 << 16  # of the hash that picks the sample
LANDMARKS = 256
RIDGE = 1e-3
BATCH = 256
CHUNK = 1 << 18  # characters looked at once
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def presence(text: str | None) -> np.ndarray | None:
    """Sorted places of the n-grams in the whole text, lower case, all but letters as one space; None without a letter."""
    if not text:
        return None
    letters = is_letter()
    text = text.lower()
    seen, any_letter, last = np.zeros(1 << BITS, bool), False, np.zeros(0, np.uint32)
    for start in range(0, len(text), CHUNK):
        code = np.frombuffer(text[start : start + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
        alpha = letters[code]
        any_letter = any_letter or bool(alpha.any())
        code = np.concatenate([last, np.where(alpha, code, 32).astype(np.uint32)])
        code = code[np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]]
        last = code[1 - max(ORDERS) :]  # n-grams across the cut begin here, spaces already made one
        code = code.astype(np.uint64)
        for n in ORDERS:
            if len(code) >= n:
                gram = np.full(len(code) - n + 1, n, np.uint64)
                for i in range(n):
                    gram = (gram << U(20)) + code[i : len(code) - n + 1 + i]
                seen[(mix(gram) >> U(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.uint16) if any_letter else None


def unit_rows(places: list[np.ndarray]) -> np.ndarray:
    """Presence vectors of length one; kernels are products of such rows."""
    out = np.zeros((len(places), 1 << BITS), np.float32)
    for row, p in zip(out, places, strict=True):
        row[p] = 1 / math.sqrt(len(p)) if len(p) else 0
    return out


class Model:
    """Languages and the matrix that turns unit presence rows into one score per language."""

    def __init__(self, labels: list[str], places: list[np.ndarray]):
        self.langs = sorted(set(labels))
        order = np.argsort([sum(p[:64].astype(int)) * 2654435761 % 1000003 for p in places], kind="stable")
        turn: dict[str, int] = {}
        rank = []
        for i in order:  # landmarks take turns among the languages
            turn[labels[i]] = turn.get(labels[i], 0) + 1
            rank.append((turn[labels[i]], int(i)))
        marks = unit_rows([places[i] for _, i in sorted(rank)[:LANDMARKS]])
        kernel = np.concatenate([unit_rows(places[s : s + BATCH]) @ marks.T for s in range(0, len(places), BATCH)]).astype(np.float64)
        target = np.where(np.array(labels)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        between = (marks @ marks.T).astype(np.float64)
        left = kernel.T @ kernel + RIDGE * len(labels) * between + 1e-9 * len(labels) * np.eye(len(marks))
        self.weights = (marks.T @ np.linalg.solve(left, kernel.T @ target)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        places = [presence(t) for t in texts]
        rows = unit_rows([np.zeros(0, np.uint16) if p is None else p for p in places])
        raw = 4.0 * (rows @ self.weights).astype(np.float64)
        likely = np.exp(raw - raw.max(axis=1, keepdims=True))
        likely /= likely.sum(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        return [(UNKNOWN, 0.0) if p is None else (self.langs[b], float(row[b])) for p, b, row in zip(places, best, likely, strict=True)]


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """Model from ``labelled``; None if no row has a language and a letter.

    Learns from ``SAMPLE`` rows, an equal number of each language (all of its rows if it has fewer): those with the smallest hashes of id and
    text. So the bound holds for repeated rows and NULL ids too.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    drawn = F.xxhash64("id", "text", F.lit(7))
    rows = rows.select("lang", "text", drawn.alias("drawn"), F.pmod(drawn, F.lit(SLOTS)).alias("slot"))
    # The slots of the hash that hold each language's first rows, so that texts beyond them stay where they are.
    counts = settle(rows.groupBy("lang", "slot").count())
    languages = counts.select("lang").distinct().count()
    if not languages:
        return None
    each = max(SAMPLE_LEAST, SAMPLE // languages)
    before = F.sum("count").over(Window.partitionBy("lang").orderBy("slot")) - F.col("count")
    upto = counts.withColumn("before", before).where(F.col("before") < each).groupBy("lang").agg(F.max("slot").alias("upto")).collect()  # one row a language
    few = rows.where(F.col("slot") <= F.create_map(*[F.lit(x) for r in upto for x in r])[F.col("lang")])

    def run(batches):
        for batch in batches:
            found = [presence(t.as_py()) for t in batch.column("text")]
            places = pa.array([None if p is None else p.tobytes() for p in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("drawn"), places], ["lang", "drawn", "places"])

    seen = few.select("lang", "text", "drawn").mapInArrow(run, "lang string, drawn long, places binary").where("places IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("drawn", F.lit(SLOTS)), "drawn", "places"))
    sample = seen.withColumn("turn", turn).where(F.col("turn") <= each)
    got = [(r[0], np.frombuffer(r[1], np.uint16)) for r in sample.select("lang", "places").collect()]
    if not got:
        return None
    got.sort(key=lambda r: (r[0], r[1].tobytes()))
    return Model([r[0] for r in got], [r[1] for r in got])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row; ``und`` with score 0 for a text that is NULL or has no letter, or without a model."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column("text").to_pylist()
                found = model.predict(texts) if model else [(UNKNOWN, 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")
