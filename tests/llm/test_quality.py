"""The discriminant against a plain float version on a whole table, held-out accuracy, odd rows."""

import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitloom.llm import quality

FOLDER = "/root/testdata/sf0.01"


def gaussian(rows):
    return rows.mean(0), np.cov(rows.T, bias=True)


def plain_model(rows, labels, common, identity):
    """Log odds of quality 1, by covariances, determinants and solved systems in floats."""
    apart = [rows[labels == y] for y in (0, 1)]
    pooled = sum(len(own) * gaussian(own)[1] for own in apart) / len(rows)
    unit = np.sqrt(np.diag(pooled))
    unit = np.where(unit > 1 / quality.SCALE, unit, 1)
    parts = []
    for own in apart:
        mean, cov = gaussian(own)
        mixed = ((1 - common) * cov + common * pooled) / np.outer(unit, unit)
        shrunk = (1 - identity) * mixed + identity * max(np.trace(mixed) / len(mixed), 1e-3) * np.eye(len(mixed))
        parts.append((mean, shrunk, np.log(len(own) / len(rows))))

    def odds(x):
        density = []
        for mean, cov, prior in parts:
            z = (x - mean) / unit
            density.append(prior - np.linalg.slogdet(cov)[1] / 2 - (z * np.linalg.solve(cov, z.T).T).sum(1) / 2)
        return density[1] - density[0]
    return odds


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    gold = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    vectors = {i: tuple(quality.vector(t or "")) for i, t in docs.items()}
    by_vector = {}
    for i, label in gold.items():
        if i in docs and not held[i]:
            by_vector.setdefault(vectors[i], []).append(label)
    stats = spark.createDataFrame([(list(v),) for v in by_vector], "stats array<int>")
    folds = {tuple(r[0]): r[1] for r in stats.select("stats", F.pmod(F.xxhash64("stats"), F.lit(quality.FOLDS))).collect()}
    keys = sorted(by_vector)
    rows = np.array(keys) / quality.SCALE
    labels, fold = np.array([np.mean(by_vector[k]) >= 0.5 for k in keys]).astype(int), np.array([folds[k] for k in keys])
    choices = list(product(quality.TOWARDS_COMMON, quality.TOWARDS_IDENTITY))[::-1]
    losses = []
    for choice in choices:
        loss = 0
        for k in range(quality.FOLDS):
            odds = np.clip(plain_model(rows[fold != k], labels[fold != k], *choice)(rows[fold == k]), -30, 30)
            loss += np.rint(np.logaddexp(0, np.where(labels[fold == k] == 1, -1, 1) * odds) * quality.LOSS_UNIT).sum()
        losses.append(loss)
    odds = plain_model(rows, labels, *choices[int(np.argmin(losses))])
    expected = {i: 1 / (1 + np.exp(-np.clip(odds(np.array([v]) / quality.SCALE)[0], -30, 30))) for i, v in vectors.items()}

    found = quality.op12_quality_classifier(spark, FOLDER)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    out = {r["doc_id"]: r for r in found.collect()}
    assert set(out) == set(docs)
    for i, row in out.items():
        assert row["held_out"] == held[i] and row["predicted"] == int(row["score"] >= quality.THRESHOLD)
        assert abs(row["score"] - expected[i]) < 1e-5
    right = [out[i]["predicted"] == label for i, label in gold.items() if held.get(i)]
    assert np.mean(right) >= 0.97


def test_odd_rows(spark, stored):
    texts = [None, "", " ", "Word", "a" * 100_000, "same text.", "same text.", "Clean words go on here.", "!!! ### $$$", "x\n" * 20_000]
    docs = stored([(None if i == 3 else i // 2, text) for i, text in enumerate(texts)])
    labels = spark.createDataFrame([(None, 1), (0, None), (1, 1), (1, 0), (2, 1), (4, 0), (4, 0), (77, 1)], "doc_id long, quality int")
    stats = quality.statistics_of(docs)
    found = quality.scored(stats, quality.fit(stats, labels)).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)
    again = quality.scored(stats, quality.fit(stats, labels)).collect()
    assert sorted(found, key=repr) == sorted(again, key=repr)


def test_without_labels(spark, stored):
    docs = stored([(1, "one text"), (2, None)])
    stats = quality.statistics_of(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    good = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for labels in (none, good):
        assert [r["score"] for r in quality.scored(stats, quality.fit(stats, labels)).collect()] == [1.0, 1.0]
    empty = quality.statistics_of(stored([]))
    assert quality.scored(empty, quality.fit(empty, good)).count() == 0


@pytest.mark.parametrize("statistic", quality.NAMES)
def test_statistics_stay_in_range(statistic):
    at = quality.NAMES.index(statistic)
    for text in ("", " ", "a", "!" * 50_000, "é" * 10, "A B " * 30_000, "\n" * 9, "\x00\t"):
        assert abs(quality.vector(text)[at]) < 16 * quality.SCALE


def test_a_moment_sum_is_exact():
    rows = np.array([[2 ** 13 + i, i % 3] for i in range(1000)], object)
    whole = quality.Moments(1000, rows.sum(0), rows.T @ rows)
    parts = quality.Moments(400, rows[:400].sum(0), rows[:400].T @ rows[:400]) + quality.Moments(600, rows[400:].sum(0), rows[400:].T @ rows[400:])
    assert (whole.scatter() == parts.scatter()).all()
    assert np.allclose(whole.scatter(), np.cov(rows.astype(float).T, bias=True) * 1000 / quality.SCALE ** 2)
