"""Text quality by a regularised quadratic discriminant.

A text becomes a vector of transformed statistics: logarithms of lengths and ratios, square roots of
shares, all smoothed so that a short text lies near the middle, and rounded to whole multiples of
1 / 1024.  Each class (quality 0 and 1) is a Gaussian.  Its covariance is shrunk twice, towards the covariance
of both classes and towards a multiple of the identity; how far is chosen by cross-validation.  The score is the
logistic of the log-density difference, from Mahalanobis distances by Cholesky factors that are
inverted once and kept in the model, and of the classes' shares.

Labels are learned only from rows that are not held out (crc32 of the id's text, modulo 5, is 0), and from all of
those: means and covariances come from sums and products of the whole numbers, which Spark adds up exactly, so no
sample is taken, nothing but sums reaches the driver, and the order of rows and tasks changes no bit.  A label is
never an input of a score, nor are ids, languages or sources: equal texts score alike.

Texts with one vector count once, by the mean of their labels, so copies of a text weigh as one.  Labels that
repeat an id count by their mean.  A null id counts as not held out and trains nothing.  Null and empty texts have
the statistics of a text without words.  Without labelled rows of both classes every score is the share of quality 1
among the labelled rows, and 1 if there are none: nothing speaks against a text then.  Rows that repeat an id have
scores of their own, further columns are left out, an empty table gives no rows, and a text is read whole whatever its length.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import product
from math import log, log1p, sqrt
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.common import table
from unitloom.session import cut_lineage

#: Statistics are whole multiples of 1 / SCALE.
SCALE = 1024
HELD_OUT, FOLDS, THRESHOLD = 5, 5, 0.3
#: Shares tried for the common covariance and for the identity.
TOWARDS_COMMON, TOWARDS_IDENTITY = (0.0, 0.1, 0.3, 0.6), (0.001, 0.01, 0.05, 0.2)
#: Losses are added up in whole millionths.
LOSS_UNIT = 1_000_000

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER, _DIGITS, _STOPS, _SYMBOLS, _WIDE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGITS[48:58] = True
_STOPS[list(b".,;:?'\"()-")] = True
_SYMBOLS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = True
_WIDE[128:] = True
_KINDS = np.stack([_LETTERS, _UPPER, _DIGITS, _STOPS, _SYMBOLS, _WIDE]).astype(float).T

NAMES = (
    "length", "word_length", "upper", "digits", "stops", "symbols", "wide", "entropy", "distinct_words", "repeats", "top_word",
    "odd_words", "line_length", "repeated_lines",
)


def _share(part: float, whole: float, usual: float, weight: float) -> float:
    """Square root of a share that stays near ``usual`` while ``whole`` is small."""
    return sqrt((part + usual * weight) / (whole + weight))


def statistics(text: str) -> list[float]:
    """The statistics named in ``NAMES``."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(data, minlength=256)
    letters, upper, digits, stops, symbols, wide = (counts @ _KINDS).tolist()
    held = counts[counts > 0]
    n = len(data)
    entropy = float(log(n) - (held * np.log(held)).sum() / n) if n else 0.0
    words = text.split()
    distinct, w = Counter(words), len(words)
    top = distinct.most_common(1)[0][1] if w else 0
    lines = text.split("\n")
    odd = sum(count for word, count in distinct.items() if not word[-1].isalnum() and word[-1] not in ".,;:?'\")") if symbols else 0
    return [
        log1p(n), log((n + 20) / (w + 4)), _share(upper, letters, 0.02, 50), _share(digits, n, 0.005, 100), _share(stops, n, 0.02, 50),
        _share(symbols, n, 0.002, 50), _share(wide, n, 0.03, 50), (entropy * n + 2.8 * 50) / (n + 50), log((len(distinct) + 10) / (w + 10)),
        _share(sum(map(eq, words, words[1:])), w, 0.002, 10), _share(top, w, 0.05, 10), _share(odd, w, 0.002, 10),
        log((n + 60) / (len(lines) + 1)), _share(len(lines) - len(set(lines)), len(lines), 0.002, 5),
    ]


def vector(text: str) -> list[int]:
    return [round(value * SCALE) for value in statistics(text)]


def statistics_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) of each row; a table of a few bytes per statistic, written once."""
    def read(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [vector(value or "") for value in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "stats"])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut_lineage(texts.mapInArrow(read, "doc_id long, stats array<int>"), "statistics")


@dataclass
class Moments:
    """Number, sums and sums of products of vectors, in whole numbers."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums]) / SCALE

    def scatter(self) -> np.ndarray:
        """Sum of squares around the mean; exact until the last division."""
        exact = self.products * self.n - np.outer(self.sums, self.sums)
        return exact.astype(float) / self.n / SCALE ** 2


def _no_moments(size: int = len(NAMES)) -> Moments:
    return Moments(0, np.zeros(size, object), np.zeros((size, size), object))


@dataclass
class Model:
    """Two Gaussians on standardised statistics: means, inverted Cholesky factors, and the constant of the score."""

    share: float
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    constant: float = 0.0

    def odds(self, vectors: np.ndarray) -> np.ndarray:
        """Log odds of quality 1, by rows of whole numbers."""
        rows = (vectors / SCALE - self.centre) / self.spread
        far = [(((rows - mean) @ factor.T) ** 2).sum(1) for mean, factor in zip(self.means, self.factors)]
        return self.constant + (far[0] - far[1]) / 2

    def score(self, vectors: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(vectors), self.share)
        return np.round(1 / (1 + np.exp(-np.clip(self.odds(vectors), -30, 30))), 9)


def discriminant(moments: tuple[Moments, Moments], common: float, identity: float) -> Model:
    """The model of two classes' moments at given shares of the common covariance and the identity."""
    n = moments[0].n + moments[1].n
    share = moments[1].n / n if n else 1.0
    if not moments[0].n or not moments[1].n:
        return Model(share)
    pooled = moments[0].scatter() + moments[1].scatter()
    centre = (moments[0] + moments[1]).mean()
    # a statistic that never varies within a class says nothing and keeps its unit
    spread = np.sqrt(np.diag(pooled) / n)
    spread = np.where(spread > 1 / SCALE, spread, 1.0)
    scale = np.outer(spread, spread)
    means, factors, constant = [], [], log(share / (1 - share))
    for sign, own in zip((1, -1), moments):
        mixed = (1 - common) * own.scatter() / own.n + common * pooled / n
        mixed = mixed / scale
        size = np.trace(mixed) / len(mixed)
        shrunk = (1 - identity) * mixed + identity * max(size, 1e-3) * np.eye(len(mixed))
        lower = np.linalg.cholesky(shrunk)
        means.append((own.mean() - centre) / spread)
        factors.append(np.linalg.solve(lower, np.eye(len(lower))))
        constant += sign * np.log(np.diag(lower)).sum()
    return Model(share, centre, spread, tuple(means), tuple(factors), constant)


def _fold_moments(training: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments per (label, fold): tasks add up their rows, Spark adds up the tasks."""
    size = len(NAMES)

    def partial(batches):
        totals: dict = {}
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(-1, size)
            group = batch.column(1).to_numpy().astype(np.int64) * FOLDS + batch.column(2).to_numpy()
            full = np.column_stack([np.ones(len(rows), np.int64), rows])
            for g in np.unique(group):
                own = full[group == g]
                totals[g] = totals.get(g, 0) + own.T @ own
        for g, square in totals.items():
            i, j = np.triu_indices(size + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), g), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              pa.array(square[i, j], pa.int64())], names=["g", "i", "j", "value"])

    sums = training.mapInArrow(partial, "g int, i int, j int, value long").groupBy("g", "i", "j").agg(F.sum("value").alias("value")).collect()
    squares: dict = {}
    for g, i, j, value in sums:  # at most 2 * FOLDS squares of the statistics' number
        square = squares.setdefault(g, np.zeros((size + 1, size + 1), object))
        square[i, j] = square[j, i] = int(value)
    found = {(y, k): _no_moments() for y, k in product((0, 1), range(FOLDS))}
    found.update({(g // FOLDS, g % FOLDS): Moments(s[0, 0], s[0, 1:], s[1:, 1:]) for g, s in squares.items()})
    return found


def _losses(training: DataFrame, models: list[list[Model]]) -> list[int]:
    """Log loss of each choice, summed over the rows of each fold, by models that have not seen the fold."""
    size = len(NAMES)

    def partial(batches):
        totals = np.zeros(len(models), np.int64)
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(-1, size)
            labels, folds = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(folds):
                here = folds == k
                sign = np.where(labels[here] == 1, -1.0, 1.0)
                for choice, of_folds in enumerate(models):
                    odds = np.clip(of_folds[k].odds(rows[here]), -30, 30)
                    totals[choice] += np.rint(np.logaddexp(0, sign * odds) * LOSS_UNIT).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(totals)], names=["choice", "loss"])

    sums = training.mapInArrow(partial, "choice int, loss long").groupBy("choice").agg(F.sum("loss").alias("loss")).collect()
    by_choice = {row["choice"]: row["loss"] for row in sums}
    return [by_choice.get(choice, 0) for choice in range(len(models))]


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, label, fold) of the distinct vectors of labelled rows that are not held out."""
    gold = cut_lineage(labels.where(
        f"doc_id IS NOT NULL AND quality IS NOT NULL AND pmod(crc32(cast(doc_id AS string)), {HELD_OUT}) <> 0"
    ).groupBy("doc_id").agg(F.avg("quality").alias("quality")), "gold")
    vectors = stats.join(gold, "doc_id").groupBy("stats").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return cut_lineage(vectors.select("stats", "label", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).cast("int").alias("fold")), "training")


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The discriminant of a table of statistics and of ``labels`` (doc_id, quality)."""
    training = training_rows(stats, labels)
    found = _fold_moments(training)

    def without(fold: int | None) -> tuple[Moments, Moments]:
        return tuple(sum((found[y, k] for k in range(FOLDS) if k != fold), _no_moments()) for y in (0, 1))

    choices = list(product(TOWARDS_COMMON, TOWARDS_IDENTITY))[::-1]  # of equal choices, the most shrunk
    models = [[discriminant(without(fold), *choice) for fold in range(FOLDS)] for choice in choices]
    if any(model.means is None for model in models[0]):  # a class in one fold only, or in none
        return discriminant(without(None), *choices[0])
    losses = _losses(training, models)
    return discriminant(without(None), *choices[int(np.argmin(losses))])


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of a table of statistics."""
    size = len(NAMES)

    def score(batches):
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(rows), pa.float64())], names=["doc_id", "score"])
    return stats.mapInArrow(score, "doc_id long, score double")


def op12_quality_classifier(spark, folder: str) -> DataFrame:
    stats = statistics_of(table(spark, folder, "documents"))
    model = fit(stats, table(spark, folder, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(HELD_OUT)) == 0, F.lit(False))
    return scored(stats, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
