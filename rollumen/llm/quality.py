"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - theta_k), with one weight vector for all grades and thresholds that increase (their
steps are exponentials). x is the mean over a text's words of hashed one-hot features: the word in lower case, its
shape (runs of capitals, letters, digits and marks), its last marks, and whether it repeats the word before; so a text's
length doesn't matter and junk in a part of it counts in proportion. Grades are the distinct integer ratings of the
fitting sample, in order; two ratings give one threshold.

Nulls: a null text is the empty one, with x = 0 and the intercepts alone; a null id is graded like any other. Without
ratings, or with one grade only, every document gets that grade (0 without any) and is kept. Texts of any length are read
whole; equal texts and repeated rows get equal results; an empty table gives none. Other columns, whatever their names, are
ignored by grade() and kept as they are by selected().
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rollumen.llm.common import crc32_text
from rollumen.llm.sampling import fit_sample

#: Rated rows that the model is fitted on, at most; hashed dimensions; words kept by a worker.
SAMPLE, DIMENSIONS, KEPT = 6_000, 1 << 17, 300_000
SHAPE = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zà-öø-ÿß]+"), "a"), (re.compile(r"\d+"), "9"))


def word_features(word: str) -> tuple[int, ...]:
    """Hashed dimensions of one word."""
    from xxhash import xxh32_intdigest

    shape = word
    for pattern, mark in SHAPE:
        shape = pattern.sub(mark, shape)
    tail = word[len(word.rstrip("!?.,;:|*#$%&<>~^_=+-")) :]
    return tuple(xxh32_intdigest(x) % DIMENSIONS for x in (f"w {word.lower()}", f"s {shape[:24]}", f"t {tail[:8]}"))


REPEATED = word_features("\x00 repeated")[0]


def repeats(words: list[str]) -> int:
    return sum(map(str.__eq__, words[1:], words)) if len(words) > 1 else 0


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values of a text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    got = [d for w in words for d in word_features(w)] + [REPEATED] * repeats(words)
    at, n = np.unique(np.array(got, np.int32), return_counts=True)
    return at, (n / len(words)).astype(np.float32)


class Ordinal:
    """Weights, thresholds and grades; fit() by Adagrad on the whole sample at each step."""

    def __init__(self, grades: list[int]) -> None:
        self.grades, self.w = grades, np.zeros(DIMENSIONS)
        self.theta = np.zeros(max(len(grades) - 1, 0))

    def fit(self, rows: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.5, l2: float = 1e-6) -> Ordinal:
        """rows, at, value: the sample's vectors, cell by cell. y: positions in grades."""
        k, n = len(self.theta), len(y)
        above = y[:, None] > np.arange(k)
        # thresholds begin at the log-odds of the grades' shares, the fit without any features
        first = np.log(np.clip(1 - above.mean(0), 1e-3, 1 - 1e-3) / np.clip(above.mean(0), 1e-3, 1))
        raw = np.append(first[:1], np.log(np.maximum(np.diff(first), 1e-2)))
        gw, graw = np.full(DIMENSIONS, 1e-8), np.full(k, 1e-8)
        for _ in range(steps):
            theta = np.cumsum(np.append(raw[:1], np.exp(raw[1:])))
            eta = np.bincount(rows, value * self.w[at], n)
            c = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -30, 30)))  # P(grade > k)
            # the likelihood of a grade is the difference of neighbouring tails
            full = np.concatenate([np.ones((n, 1)), c, np.zeros((n, 1))], 1)
            d = np.concatenate([np.zeros((n, 1)), c * (1 - c), np.zeros((n, 1))], 1)
            i = np.arange(n)
            like = np.maximum(full[i, y] - full[i, y + 1], 1e-9)
            up, down = d[i, y] / like / n, d[i, y + 1] / like / n
            g = np.bincount(at, (up - down)[rows] * value, DIMENSIONS) - l2 * self.w
            gt = np.zeros(k + 2)
            np.add.at(gt, y, -up)
            np.add.at(gt, y + 1, down)
            gt = gt[1:-1]
            tail = np.cumsum(gt[::-1])[::-1]
            gr = np.append(tail[:1], tail[1:] * np.exp(raw[1:]))
            gw += g * g
            graw += gr * gr
            self.w += rate * g / np.sqrt(gw)
            raw += 0.3 * rate * gr / np.sqrt(graw)
        self.theta = np.cumsum(np.append(raw[:1], np.exp(raw[1:])))
        return self

    def tails(self, eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.theta, -30, 30)))


class WordScores(dict):
    """w . features of each word; kept for words seen before, up to KEPT."""

    def __init__(self, w: np.ndarray) -> None:
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> float:
        got = float(self.w[list(word_features(word))].sum())
        if len(self) >= KEPT:
            self.clear()
        self[word] = got
        return got


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, held_out: int | None = None) -> Ordinal:
    sample = fit_sample(docs, labels, "quality", bound, held_out)

    def cells(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [vector(t) for t in f["text"]]
            yield pd.DataFrame({"h": [hash_of(t) for t in f["text"]], "y": f["y"], "at": [a.tobytes() for a, _ in got], "v": [v.tobytes() for _, v in got]})

    got = sample.mapInPandas(cells, "h long, y int, at binary, v binary").toPandas().sort_values(["h", "y"])
    grades = sorted(set(got["y"].tolist()))
    model = Ordinal(grades)
    if len(grades) > 1:
        at = [np.frombuffer(x, np.int32) for x in got["at"]]
        value = [np.frombuffer(x, np.float32) for x in got["v"]]
        rows = np.repeat(np.arange(len(got)), [len(a) for a in at])
        model.fit(rows, np.concatenate(at), np.concatenate(value).astype(float), np.searchsorted(grades, got["y"].to_numpy()))
    return model


def hash_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text) >> 1


class Grader:
    """Expected grades and tail probabilities, P(grade >= least), of texts; least: the top grade if None."""

    def __init__(self, model: Ordinal, least: int | None) -> None:
        self.model, self.score, self.step = model, WordScores(model.w), float(model.w[REPEATED])
        self.grades = np.array(model.grades or [0], float)
        self.k = int(np.searchsorted(self.grades, self.grades[-1] if least is None else least))

    def grade(self, texts: Iterable) -> tuple[np.ndarray, np.ndarray]:
        eta = []
        for t in texts:
            words = (t.as_py() or "").split()
            eta.append((sum(map(self.score.__getitem__, words)) + self.step * repeats(words)) / len(words) if words else 0.0)
        tails = self.model.tails(np.array(eta, float))
        tail = np.ones(len(eta)) if self.k == 0 else tails[:, self.k - 1] if self.k <= tails.shape[1] else np.zeros(len(eta))
        return self.grades[0] + tails @ np.diff(self.grades), tail


def grade(docs: DataFrame, model: Ordinal, least: int | None = None, cutoff: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_prob, kept."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grader(model, least)
        for b in batches:
            mean, tail = own.grade(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean), pa.array(tail)], names=["doc_id", "expected_grade", "tail_prob"])

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([plain.schema["doc_id"], StructField("expected_grade", DoubleType()), StructField("tail_prob", DoubleType())])
    return plain.mapInArrow(scan, schema).withColumn("kept", F.col("tail_prob") >= cutoff)


def selected(docs: DataFrame, model: Ordinal, least: int | None = None, cutoff: float = 0.5) -> DataFrame:
    """The rows of docs whose tail probability is at least the cutoff, with the columns of docs."""
    fields = [StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(docs.schema)]  # any names, even clashing ones
    at = docs.columns.index("text")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grader(model, least)
        for b in batches:
            yield b.filter(pa.array(own.grade(b.column(at))[1] >= cutoff))

    kept = docs.toDF(*[f.name for f in fields]).mapInArrow(scan, StructType(fields))
    return kept.toDF(*docs.columns)


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob, kept; fitted on rows that are not held out."""
    model = fit(docs, labels, held_out=0)
    return grade(docs, model).withColumn("held_out", crc32_text() % 5 == 0)
