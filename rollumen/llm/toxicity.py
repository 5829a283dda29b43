"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, plain and obfuscated; how close lexicon words stand to
second-person words; rates of capitals, of punctuation and of obfuscated words; length. The lexicon's learned part are
words that are far more frequent in toxic documents of the fitting rows. Two thirds of the sample, by a hash of the text, are
the fitting rows: of the learned lexicon, and of the trees, by logistic loss. The rest, which neither has seen, sets a
monotone map from margins to probabilities.

Nulls: a null text is the empty one and gets a score like any other; so does a null id. With no usable labels, or labels of
one kind, the score is their mean (0 without any). Texts of any length are read whole. Equal texts and repeated rows get equal
scores. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rollumen.llm.common import crc32_text
from rollumen.llm.sampling import fit_sample

#: Labelled rows that the trees are fitted on, at most; and words of the learned lexicon.
SAMPLE, LEXICON, KEPT = 16_000, 200, 300_000
INSULTS = frozenset(
    "ass asshole bastard bitch bullshit coward creep crap cretin cunt damn degenerate despicable dick dimwit disgusting "
    "dumb dumbass fag faggot filth filthy fool freak fuck fucking garbage hate hideous idiot idiotic imbecile kill liar "
    "loser maggot moron moronic nazi parasite pathetic pig prick psycho retard retarded scum shit shut slut "
    "stupid subhuman sucks terrorist thug traitor trash ugly useless vermin whore worthless".split()
)
SECOND = frozenset("you your yours yourself yourselves u ur you're du dich dir dein deine tu te toi ton vous votre ti tus usted ustedes".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
EDGES = string.punctuation + "«»“”’¡¿"
BITS = ("insult", "learned", "second", "capitals", "obfuscated", "obfuscated_insult", "exclaims", "punctuated")
FEATURES = (*BITS, "insults", "learned_n", "learned_weight", "heaviest", "proximity", "near", "upper_rate", "punctuation_rate", "digit_rate", "length")


class WordCodes(dict):
    """Bits of each word as it stands in a text; kept for words seen before, up to KEPT."""

    def __init__(self, learned: dict[str, float]) -> None:
        super().__init__()
        self.learned = learned

    def __missing__(self, word: str) -> int:
        core = word.strip(EDGES)
        low = core.lower()
        plain = low.translate(LEET)
        mixed = any(c.isalpha() for c in low) and not low.isalpha()
        clear = "".join(c for c in plain if c.isalpha()) if mixed else low
        code = (
            (low in INSULTS)
            | (low in self.learned) << 1
            | (low in SECOND) << 2
            | (len(core) > 1 and core.isupper()) << 3
            | mixed << 4
            | (mixed and clear != low and (clear in INSULTS or clear in self.learned)) << 5
            | (word[-1:] in "!?" and bool(word)) << 6
            | (word != core) << 7
        )
        if len(self) >= KEPT:
            self.clear()
        self[word] = code
        return code


_OF_CODE = np.array([[c >> b & 1 for b in range(8)] for c in range(256)], float)
_UPPER, _PUNCT, _DIGIT = (x.encode() for x in (string.ascii_uppercase, string.punctuation, string.digits))


def features(text: str, codes: WordCodes) -> np.ndarray:
    words = text.split()
    n = len(words)
    code = np.fromiter(map(codes.__getitem__, words), np.uint8, n)
    bits = np.bincount(code, minlength=256) @ _OF_CODE
    hits = np.flatnonzero(code & 0b100011)
    weights = [codes.learned.get(words[i].strip(EDGES).lower(), 0.0) for i in hits.tolist()]
    you = np.flatnonzero(code & 4)
    gap = np.full(1, 1e9)
    if len(hits) and len(you):
        k = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(k, len(you) - 1)]), np.abs(hits - you[np.maximum(k - 1, 0)]))
    data = text.encode()
    size = max(1, len(data))
    rates = [(len(data) - len(data.translate(None, x))) / size for x in (_UPPER, _PUNCT, _DIGIT)]
    return np.array(
        [*(bits / max(n, 1)), bits[0] + bits[5], bits[1], sum(weights) / max(n, 1) ** 0.5, max(weights, default=0.0), 1 / (1 + gap.min()), (gap <= 5).sum(), *rates, np.log1p(n)],
        np.float64,
    )


class Boosted:
    """Trees of a fixed depth, grown level by level on binned features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 3.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # rare values above zero get cuts of their own
        cuts = [np.unique(np.append(q, np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1]) if (c > 0).any() else [])) for q, c in zip(cuts, x.T)]
        binned = np.stack([np.searchsorted(q, c, side="right") for q, c in zip(cuts, x.T)], 1)
        wide, f = int(binned.max()) + 1, x.shape[1]
        at = np.full(len(x), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-at))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(x), np.int64)
            split: list[tuple[np.ndarray, np.ndarray]] = []
            for level in range(self.depth):
                m = 1 << level
                hist = np.zeros((2, f, m, wide))
                for j in range(f):
                    cell = node * wide + binned[:, j]
                    hist[0, j] = np.bincount(cell, g, m * wide).reshape(m, wide)
                    hist[1, j] = np.bincount(cell, h, m * wide).reshape(m, wide)
                gl, hl = np.cumsum(hist[0], 2), np.cumsum(hist[1], 2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < self.least) | (ht - hl < self.least)] = -1
                flat = gain.transpose(1, 0, 2).reshape(m, -1)
                best = flat.argmax(1)
                feature, b = best // wide, best % wide
                feature[flat[np.arange(m), best] <= 1e-9] = -1
                limit = np.array([cuts[j][k] if j >= 0 and k < len(cuts[j]) else np.inf for j, k in zip(feature, b)])
                split.append((np.maximum(feature, 0), limit))
                node = node * 2 + (x[np.arange(len(x)), split[-1][0][node]] >= limit[node])
            m = 1 << self.depth
            leaf = -self.rate * np.bincount(node, g, m) / (np.bincount(node, h, m) + self.l2)
            self.trees.append((split, leaf))
            at += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for split, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, limit in split:
                node = node * 2 + (x[rows, feature[node]] >= limit[node])
            out += leaf[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and probabilities between which to interpolate."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of margins
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        pools.append([1.0, v, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, s, t = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2] + t]
    w, s, t = np.array(pools).T
    # half an observation of the mean keeps pools of few rows off 0 and 1
    return t / w, (s + 0.5 * y.mean()) / (w + 0.5)


def learn_lexicon(sample: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Words that stand in far more toxic documents of the sample than chance allows, with their log-odds."""

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        toxic: Counter = Counter()
        for f in frames:
            for text, y in zip(f["text"], f["y"]):
                own = {w.strip(EDGES) for w in text.lower().split()}
                seen.update(own)
                if y:
                    toxic.update(own)
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values()), "pos": [toxic[w] for w in seen]})

    words = sample.mapInPandas(count, "word string, n long, pos long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    total = sample.agg(F.count(F.lit(1)), F.sum(F.col("y").cast("double"))).first()
    rate = (total[1] or 0.0) / max(total[0], 1)
    if not 0 < rate < 1:
        return {}
    z = (F.col("pos") - F.col("n") * rate) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    odds = F.log((F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5)) - F.lit(float(np.log(rate / (1 - rate))))
    top = words.filter("pos >= 5 and word <> ''").withColumn("z", z).withColumn("odds", odds).filter("z > 5 and odds > 1")
    return {r["word"]: r["odds"] for r in top.orderBy(F.desc("z"), "word").limit(most).collect()}


def feature_table(texts: DataFrame, learned: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns `keep` and x, an array of the features."""
    types = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(learned)
        for b in batches:
            x = [features(t.as_py() or "", codes) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return texts.select(*keep, "text").mapInArrow(scan, f"{types}, x array<double>")


class Model:
    def __init__(self, learned: dict[str, float], x: np.ndarray, y: np.ndarray, fitting: np.ndarray) -> None:
        """fitting: which rows the lexicon was learnt from and the trees are fitted on; the others calibrate."""
        self.learned, self.flat, self.trees = learned, float(y.mean()) if len(y) else 0.0, None
        if len(y) >= 30 and fitting.any() and not fitting.all() and 0 < y[fitting].mean() < 1:
            self.trees = Boosted().fit(x[fitting], y[fitting])
            self.at, self.p = isotonic(self.trees.margin(x[~fitting]), y[~fitting])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.flat)
        return np.clip(np.interp(self.trees.margin(x), self.at, self.p), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, held_out: int | None = 0) -> Model:
    from rollumen.llm.common import cut

    sample = cut(fit_sample(docs, labels, "toxic", bound, held_out).withColumn("y", (F.col("y") > 0).cast("int")))
    fitting = F.pmod(F.xxhash64("text"), F.lit(3)) > 0
    learned = learn_lexicon(sample.filter(fitting))
    got = feature_table(sample.withColumn("h", F.xxhash64("text")), learned, ["h", "y"]).toPandas().sort_values(["h", "y"])
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return Model(learned, x, got["y"].to_numpy(float), got["h"].to_numpy() % 3 > 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(model.learned)
        for b in batches:
            x = np.array([features(t.as_py() or "", codes) for t in b.column(1)]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    own = plain.mapInArrow(scan, StructType([plain.schema["doc_id"], StructField("score", DoubleType())]))
    return own.select("doc_id", (crc32_text() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
