"""Toxicity by weak supervision.

Voters are words (lexicon) and word beginnings (patterns) that labelled training rows tie to
toxicity.  A generative label model then looks only at how voters vote together: by expectation
maximisation it estimates how often each votes in toxic and in clean documents, and how strongly
voters are correlated within a class, so that voters that repeat each other count once.  Its
posterior labels train a linear classifier, and the classifier scores whole texts.

Labels are learned only from rows that are not held out (crc32 of the id's text, modulo 3, is
1), from at most ``labelled_rows`` of them, those with the smallest hash of their id.  A label
is never an input of a score, nor are ids, languages or sources: equal texts score alike.

Voters are chosen by the number of distinct texts that hold them, toxic and clean alike; copies of
a text count once.

Null and empty texts score as a text without words.  A null id counts as not held out and trains
nothing.  Labels that repeat an id count by their mean; without labels, every score is 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.common import ROW, keep_rows, table, with_row_key
from unitloom.session import cut_lineage

#: Bounds of the fit: labelled rows, voters, and further words the classifier may use.
LABELLED_ROWS, VOTERS, FURTHER_WORDS = 20_000, 512, 256
THRESHOLD = 0.7
#: A voter's rate among toxic training rows is at least so many times its rate among clean ones.
LEAST_LIFT = 20.0
#: English insults that vote wherever the training rows do not speak against them.
LEXICON = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "jerk",
           "imbecile", "filth", "vermin", "retard", "bastard", "bitch", "asshole", "fuck", "fucking", "shit", "slut", "whore")
BEGINNINGS = (4, 5)
#: Patterns: at least so many words of the lexicon in a text.
HITS = (2, 4)
#: Voters correlated at least so much within toxic rows repeat each other.
REPEATS = 0.6

_WORD = re.compile(r"\w+")


def units_of(text: str) -> set[str]:
    """Words and word beginnings of a text."""
    words = set(_WORD.findall(text.lower()))
    return {"w:" + word for word in words} | {f"b{n}:{word[:n]}" for word in words for n in BEGINNINGS if len(word) >= n}


def _count_units(batches):
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for unit in units_of(text):
                seen.setdefault(unit, [0, 0])[0 if toxic else 1] += 1
    names = list(seen)
    for start in range(0, len(names), 50_000):
        part = names[start:start + 50_000]
        values = [seen[name] for name in part]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), *[pa.array([v[i] for v in values], pa.int64()) for i in range(2)]],
            names=["unit", "toxic", "clean"])


def count_units(sample: DataFrame) -> tuple[DataFrame, int, int]:
    """(unit, toxic, clean), how many distinct texts of each class hold a unit; and those of each class.

    Copies of a text count once, by the mean of their labels.
    """
    texts = sample.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(
        F.first("text").alias("text"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    texts = cut_lineage(texts.select("text", "toxic"), "distinct")
    totals = texts.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))).first()
    counted = texts.mapInArrow(_count_units, "unit string, toxic long, clean long").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return cut_lineage(counted, "units"), totals[0], totals[1]


def repeats_of(words: list[str], distinct: set[str], lexicon: set[str]) -> list[str]:
    """Pattern units: how often words of the lexicon come up in a text, however they repeat."""
    hits = sum(words.count(word) for word in distinct & lexicon)
    return [f"p:{least}" for least in HITS if hits >= least]


@dataclass
class Model:
    """Units with their place in ``weights``, whose last entry is the intercept."""

    units: dict[str, int]
    weights: np.ndarray
    lexicon: set[str]

    def score(self, text: str) -> float:
        if not len(self.weights):
            return 0.0
        total, places, get = self.weights[-1], set(), self.units.get
        words = _WORD.findall(text.lower())
        distinct = set(words)
        for unit in repeats_of(words, distinct, self.lexicon):
            places.add(get(unit))
        for word in distinct:
            places.add(get("w:" + word))
            for n in BEGINNINGS:
                places.add(get(f"b{n}:{word[:n]}") if len(word) >= n else None)
        places.discard(None)
        total += sum(self.weights[i] for i in sorted(places))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def label_model(votes: np.ndarray, first: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior of class 1 per row of 0/1 votes, starting from the beliefs ``first``.

    A voter that is silent abstains; that all are silent is a vote of its own.
    """
    votes = np.column_stack([votes, votes.sum(1) == 0]).astype(float)
    posterior = first.astype(float)
    for _ in range(rounds):
        prior = (posterior.sum() + 1) / (len(posterior) + 2)
        rate = [(votes.T @ belief + 0.05) / (belief.sum() + 1) for belief in (1 - posterior, posterior)]
        # correlation of voters within the class of interest; repeated voters share one vote
        centred = (votes - rate[1]) * np.sqrt(posterior)[:, None]
        spread = np.sqrt((centred ** 2).sum(0)) + 1e-9
        correlation = np.clip((centred.T @ centred) / np.outer(spread, spread), 0, 1)
        correlation[correlation < REPEATS] = 0
        np.fill_diagonal(correlation, 1)
        share = 1 / correlation.sum(1)
        odds = np.log(prior / (1 - prior)) + votes @ (share * np.log(rate[1] / rate[0]))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior


def linear_classifier(rows: np.ndarray, columns: np.ndarray, n_columns: int, target: np.ndarray, steps: int = 300) -> np.ndarray:
    """Logistic regression on sparse 0/1 features against soft targets; the intercept comes last."""
    n, weights = len(target), np.zeros(n_columns + 1)
    seen = np.zeros(n_columns + 1) + 1e-8
    for _ in range(steps):
        odds = np.bincount(rows, weights=weights[columns], minlength=n) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target)
        slope = np.append(np.bincount(columns, weights=error[rows], minlength=n_columns), error.sum()) / n
        slope[:-1] += 1e-5 * weights[:-1]
        seen += slope ** 2
        weights -= 0.3 * slope / np.sqrt(seen)
    return weights


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        labelled_rows: int = LABELLED_ROWS) -> Model:
    """The classifier, from training rows that ``docs`` and ``labels`` (doc_id, toxic) share."""
    gold = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND pmod(crc32(cast(doc_id AS string)), 3) <> 1")
        .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most ``labelled_rows`` ids, so it may be sent to all
    sample = cut_lineage(texts.join(F.broadcast(gold), "doc_id").select("text", "toxic"), "sample")
    counted, *totals = count_units(sample)
    if not totals[0] or not totals[1]:
        return Model({}, np.zeros(0), set())
    rows = F.col("toxic")
    lift = (rows / totals[0]) / ((F.col("clean") + 0.05) / totals[1])
    rate, share = rows / (rows + F.col("clean")), totals[0] / (totals[0] + totals[1])
    other = F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    surprise = (rows + F.col("clean")) * (rate * F.log(rate / share) + other)
    # by chance, fewer than one of all units would be so surprising
    chosen = (surprise >= math.log(max(2, counted.count()))) | F.col("unit").isin(["w:" + word for word in LEXICON])
    voters = [row[0] for row in counted.where((rows > 0) & (lift >= LEAST_LIFT) & chosen)
        .orderBy(F.desc("toxic"), "unit").limit(VOTERS).select("unit").collect()]
    further = [row[0] for row in counted.where(F.col("unit").startswith("w:"))
               .orderBy(F.desc(F.col("toxic") + F.col("clean")), "unit").limit(FURTHER_WORDS).select("unit").collect()]
    lexicon = {unit[2:] for unit in voters if unit.startswith("w:")}
    voters += [f"p:{least}" for least in HITS]
    names = list(dict.fromkeys(voters + further))
    places = {unit: i for i, unit in enumerate(names)}

    def featured(batches):
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                words = _WORD.findall(text.lower())
                units = [*units_of(text), *repeats_of(words, set(words), lexicon)]
                found.append(sorted(places[u] for u in units if u in places))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1).cast(pa.int32())],
                                             names=["features", "toxic"])
    vectors = sample.mapInArrow(featured, "features array<int>, toxic int").toPandas()
    first = vectors["toxic"].to_numpy(float)
    rows = np.repeat(np.arange(len(vectors)), [len(f) for f in vectors["features"]])
    columns = np.concatenate([np.asarray(f, dtype=np.int64) for f in vectors["features"]]) if len(rows) else np.zeros(0, np.int64)
    votes = np.zeros((len(vectors), len(voters)), np.float32)
    voted = columns < len(voters)
    votes[rows[voted], columns[voted]] = 1
    posterior = label_model(votes, first)
    return Model(places, linear_classifier(rows, columns, len(names), posterior), lexicon)


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row key, doc_id, score) of each row."""
    keyed = with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def score(batches):
        for batch in batches:
            values = [model.score(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())],
                                             names=[ROW, "doc_id", "score"])
    return keyed.mapInArrow(score, f"{ROW} long, doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of a stored table that the classifier does not reject, with all their columns."""
    return keep_rows(docs, scored(docs, fit(docs, labels)).where(F.col("score") < threshold))


def op2_toxicity(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored(docs, fit(docs, table(spark, folder, "labels"))).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
