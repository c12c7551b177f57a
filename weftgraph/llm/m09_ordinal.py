"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is the sum of the weights of its distinct hashed features: its words, their first four and five
bytes, the marks at their ends, and two features of the whole text.  One weight vector serves all grades; ordered
thresholds cut the score: P(grade <= k) = logistic(threshold_k - score).  That gives the expected grade and the
tail probability of reaching a grade, which decides what is kept.

The model is fitted by accelerated gradient steps on a sample of rated rows, bounded by ``sample`` (the rows with
the smallest hash of their id); features of fewer than ``least_documents`` sampled rows are left out.  Scoring
covers every row, without a shuffle.

Keys can be of any type.  ``score`` reads the key and the text alone; ``select_documents`` returns all columns, whatever
their names and types, as they are.  A text is scored by one task, which holds its distinct words.

A null or empty text has no words: it gets the score of the constant features alone.  Equal texts get equal
scores.  Ratings that are null, or of unknown documents, are ignored; repeated ratings count once per row.
Without any rating, or with one grade only, the thresholds alone decide and all rows get that grade.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_rows, rewrite_rows

BITS = 18
RATE = 0.1
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + b"0123456789"


def word_features(word: bytes) -> tuple[int, ...]:
    low = word.lower()  # of bytes: A-Z alone
    core = low.strip(b".,!?*#$%&|;:\"'()<>")
    marks = word[len(word.rstrip(b"!?*#$%&|;:<>")) :][:2]
    names = [b"w" + core, b"4" + core[:4], b"5" + core[:5]] if core else []
    if marks:
        names.append(b"m" + marks)
    if word.isupper() and len(word) > 2:
        names.append(b"upper")
    return tuple(zlib.crc32(n) & (1 << BITS) - 1 for n in names)


def text_features(words: list[bytes]) -> tuple[int, ...]:
    n = len(words)
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    names = [b"all"]
    if n and 5 * stutter > n:
        names.append(b"stutter")
    if n < 5:
        names.append(b"short")
    return tuple(zlib.crc32(b"t" + x) & (1 << BITS) - 1 for x in names)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # of the hashed features
    thresholds: np.ndarray  # ordered, one fewer than grades

    def grade_probabilities(self, score: float) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(score - self.thresholds, -60, 60)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, least_documents: int = 4, least_z: float | None = None, steps: int = 300, ridge: float = 1e-5) -> OrdinalModel:
    """Minimise the mean negative log likelihood plus ``ridge / 2`` times the squared weights; ``rows`` is used up.

    ``rows`` hold the features that a text has.  Only features are weighted whose rows' share of some grade or
    better lies ``least_z`` standard errors from that of all rows: the many that say nothing would add noise to
    long texts.  By default that is a tenth of the root of the number of rows, between 4 and 12; copies among the
    rows make chance differences larger than independent rows would.
    """
    if least_z is None:
        least_z = min(12.0, max(4.0, len(rows) ** 0.5 / 10))
    weights = np.zeros(1 << BITS)
    if not rows:
        return OrdinalModel(weights, np.linspace(-1, 1, n_grades - 1))
    levels = [(grades >= k).astype(float) for k in range(1, n_grades)]
    means = [better.mean() for better in levels]
    wide = np.zeros(1 << BITS)
    above = np.zeros((len(levels), 1 << BITS))
    for i, r in enumerate(rows):  # row by row: all rows' features together would not be small
        rows[i] = r = np.unique(r)
        wide[r] += 1
        for k, better in enumerate(levels):
            above[k, r] += better[i] - means[k]
    telling = np.zeros(1 << BITS, bool)
    for better, sums in zip(levels, above):
        p = better.mean()
        telling |= np.abs(sums) > least_z * np.sqrt(np.maximum(wide * p * (1 - p), 1e-9))
    telling &= wide >= least_documents
    used = np.flatnonzero(telling)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    kept = [place[r[telling[r]]] for r in rows]
    index, row = np.concatenate(kept), np.repeat(np.arange(len(rows)), list(map(len, kept)))
    share = np.bincount(grades, minlength=n_grades).cumsum()[:-1] / len(grades)
    theta = np.log((share + 1e-3) / (1 - share + 1e-3))
    w = np.zeros(len(used))
    x, mean, square = np.concatenate([w, theta]), np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    for step in range(1, steps + 1):
        w, theta = x[: len(used)], x[len(used) :]
        s = np.bincount(row, w[index], minlength=len(rows))
        low, high = np.concatenate([[-40.0], theta])[grades], np.concatenate([theta, [40.0]])[grades]
        a, b = 1 / (1 + np.exp(np.clip(s - low, -60, 60))), 1 / (1 + np.exp(np.clip(s - high, -60, 60)))
        a, b = np.where(grades == 0, 0.0, a), np.where(grades == n_grades - 1, 1.0, b)
        p = np.maximum(b - a, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        gw = np.bincount(index, ((db - da) / len(rows))[row], minlength=len(used)) + ridge * w
        gt = np.array([(da[grades == k + 1].sum() - db[grades == k].sum()) / len(rows) for k in range(n_grades - 1)])
        g = np.concatenate([gw, gt])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        rate = RATE * (1 - (step - 1) / steps)
        x = x - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        x[len(used) :] = np.maximum.accumulate(x[len(used) :] + 1e-9 * np.arange(len(theta)))
    w, theta = x[: len(used)], x[len(used) :]
    weights[used] = w
    return OrdinalModel(weights, theta)


def featured(df: DataFrame, key: str, text: str, extra: str) -> DataFrame:
    def make():
        memo = Memo(word_features)

        def one(k, grade, raw):
            words = (raw or b"").split()
            ids = set().union(*map(memo.__getitem__, set(words)), text_features(words))
            yield k, grade, np.fromiter(sorted(ids), np.int32, len(ids)).tobytes()

        return one

    return map_rows(df, [key, extra, text], f"{key} {df.schema[key].dataType.simpleString()}, grade int, features binary", make)


def train(documents: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, sample: int = 16_000, key: str = "doc_id", text: str = "text", **options) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents; no more than their features come to the driver."""
    chosen = (
        ratings.select(F.col(key).alias("_key"), grade.cast("int").alias("_grade"))
        .where("_key IS NOT NULL AND _grade IS NOT NULL")
        .orderBy(F.xxhash64("_key"), "_key", "_grade")
        .limit(sample)
    )
    chosen = F.broadcast(chosen)  # at most ``sample`` rows of two numbers
    rows = documents.join(chosen, documents[key] == chosen["_key"]).select(documents[key].alias(key), "_grade", documents[text].alias(text))
    found = featured(rows, key, text, "_grade").toArrow().sort_by(key)
    return fit([np.frombuffer(f.as_py(), np.int32) for f in found["features"]], found["grade"].to_numpy().astype(int), n_grades, **options)


def scorer(model: tuple[np.ndarray, np.ndarray], keep_grade: int):
    """Texts to (score, expected grade, probability of ``keep_grade`` or better)."""
    weights, thresholds = model
    own = OrdinalModel(weights, thresholds)
    grades = np.arange(len(thresholds) + 1)
    memo = Memo(word_features)

    def one(raw: bytes | None) -> tuple[float, float, float]:
        words = (raw or b"").split()
        ids = set().union(*map(memo.__getitem__, set(words)), text_features(words))
        s = math.fsum(weights[list(ids)])  # exactly rounded, so that the order of features doesn't matter
        p = own.grade_probabilities(s)
        return s, float(p @ grades), float(p[keep_grade:].sum())

    return one


def score(df: DataFrame, model: OrdinalModel, keep_grade: int, keep_probability: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, expected_grade, tail_probability of ``keep_grade`` or better, kept) of every row."""
    held = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def make():
        of = scorer(held.value, keep_grade)

        def one(k, raw):
            s, expected, tail = of(raw)
            yield k, s, expected, tail, tail >= keep_probability

        return one

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, text], f"{key} {kind}, score double, expected_grade double, tail_probability double, kept boolean", make)


def select_documents(df: DataFrame, model: OrdinalModel, keep_grade: int, keep_probability: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that reach ``keep_grade`` with the probability asked for, as they are."""
    held = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def make():
        of = scorer(held.value, keep_grade)
        return lambda raws: [of(raw)[2] >= keep_probability for raw in raws]

    return rewrite_rows(df, text, make)
