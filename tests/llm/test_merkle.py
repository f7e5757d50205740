"""The manifest against a plain Python version: odd rows, trees of several heights, forged leaves."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from unitloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _place string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*inputs):
    return sha256("".join(inputs).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(hashes):
    """Root of a list of hashes, and each one's steps: its run's hashes to the left and to the right."""
    steps, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, place in enumerate(at):
            first = place // 8 * 8
            steps[i].append((hashes[first:place], hashes[place + 1:first + 8]))
            at[i] = place // 8
        hashes = [digest(*hashes[i:i + 8]) for i in range(0, len(hashes), 8)]
    return hashes[0], steps


def expected(rows):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf, forged = leaf_of(doc_id, source, lang, n_chars, text), None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            small = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            forged = leaf_of(doc_id, source, lang, n_chars, small)
        trees.setdefault(lang, []).append((doc_id, leaf, forged))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    below = {}
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        below[lang] = climb([leaf for _, leaf, _ in trees[lang]])
    if not order:
        return []
    root, above = climb([below[lang][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for (doc_id, leaf, forged), own in zip(trees[lang], below[lang][1]):
            folded = forged or leaf
            for left, right in own + above[k]:
                folded = digest(*left, folded, *right)
            proof = digest(*[h for left, right in own + above[k] for h in left + right])
            out.append((doc_id, leaf, below[lang][0], root, proof, folded, folded == root))
    return sorted(out, key=repr)


ODD = [
    (None, "No id", "en", "s", 5), (None, "No id", "en", "s", 5), (3, None, "en", None, None), (3, "", "en", "", 0),
    (7, "ABC ÄÖ", None, "s", 6), (7, "ABC ÄÖ", None, "s", 6), (8, "lone", "", "s", 4), (9, "é" * 70_000 + "Z", "é", "s", 70_001),
    (10, "x", "~", "s", 1), (11, "a:b", "z", "1:2", 3), (-5, "Minus", "en", "s", 5),
]
MANY = [(i, f"Text {i}", "en" if i % 3 else "de", f"src{i % 5}", i) for i in range(700)]
LANGS = [(i, f"T{i}", f"l{i}", "s", 1) for i in range(75)]


@pytest.mark.parametrize("rows", [MANY + ODD, LANGS, MANY[:1], []], ids=["many", "langs", "one", "none"])
def test_manifest(spark, stored, rows):
    docs = stored(rows, SCHEMA)
    folder, name = docs.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[:2]
    link = spark.read.parquet(f"{folder}/{name}")
    link.write.parquet(f"{folder}/sf/documents.parquet")
    found = merkle.op11_merkle_manifest(spark, f"{folder}/sf")
    assert found.columns == NAMES
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_paths_double(spark, stored):
    """A tree of four levels of inner nodes has its paths after two joins, and each is whole."""
    leaves = spark.range(5000).select(F.lit("=a").alias("tree"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    manifest = merkle.build(leaves, ["doc_id", "leaf"])
    root, steps = climb([digest(str(i)) for i in range(5000)])
    assert manifest.root == root
    lengths = {tuple(r) for r in merkle.paths(manifest).select("node.level", F.size("steps")).distinct().collect()}
    assert lengths == {(level, 5 - level) for level in range(1, 5)}
    folded = merkle.proofs(manifest).select("doc_id", "leaf", merkle.fold(F.col("leaf"), F.col("steps")).alias("end"), merkle.proof_text(F.col("steps")).alias("text"))
    for row in folded.collect():
        assert row["end"] == root
        assert row["text"] == "".join(h for left, right in steps[row["doc_id"]] for h in left + right)
