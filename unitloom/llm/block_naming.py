"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes.  All distinct blocks are sorted and
numbered, so a block becomes an integer that no other block has; then pairs of adjacent
integers are numbered the same way, again and again, until each document is one integer.
Two documents have the same integer (of the same round) exactly when their texts are equal:
blocks meet by content, hashes only route them, and contents that share a hash are told apart.

Null counts as the empty text, which is one empty block.  Rows that repeat an id are rows of
their own; of equal rows with the largest id one stays.  A null id is smaller than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from unitloom.llm.common import ROW, keep_rows, table, with_row_key
from unitloom.session import cut_lineage

BLOCK_BYTES = 4096

_CUT = f"{ROW} long, doc_id long, sha string, n long, pos long, block binary"


def cut_blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """Blocks of each lower-cased (A-Z) text, with the text's SHA-256 on every block."""
    keyed = with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def cut(batches):
        for batch in batches:
            lowered = pc.ascii_lower(pc.fill_null(batch.column(2), "")).cast(pa.binary())
            for start in range(0, len(lowered), 1000):
                rows, ids, shas, counts, places, blocks = [], [], [], [], [], []
                keys = batch.column(0)[start:start + 1000].to_pylist()
                names = batch.column(1)[start:start + 1000].to_pylist()
                for key, name, text in zip(keys, names, lowered[start:start + 1000].to_pylist()):
                    pieces = [text[i:i + block_bytes] for i in range(0, len(text), block_bytes)] or [b""]
                    n = len(pieces)
                    rows += [key] * n
                    ids += [name] * n
                    shas += [hashlib.sha256(text).hexdigest()] * n
                    counts += [n] * n
                    places += range(n)
                    blocks += pieces
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(shas, pa.string()),
                     pa.array(counts, pa.int64()), pa.array(places, pa.int64()), pa.array(blocks, pa.binary())],
                    names=[ROW, "doc_id", "sha", "n", "pos", "block"])

    return keyed.mapInArrow(cut, _CUT)


def _numbered(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Sort distinct keys and give each an integer; written, so that the integers stay."""
    ordered = keys.repartition(*[F.col(c) for c in columns]).sortWithinPartitions(*columns)
    return cut_lineage(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(row, pos, n, name) with one integer per distinct block content."""
    contents = blocks.groupBy("h", "block").agg(F.count(F.lit(1)).alias("copies"))
    per_hash = cut_lineage(contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")), "hashes")
    clash = per_hash.where("contents > 1").select("h")
    thin = blocks.select(ROW, "pos", "n", "h")
    if clash.isEmpty():
        keyed = thin.withColumn("tie", F.lit(0))
        keys = per_hash.select("h", F.lit(0).alias("tie"))
    else:
        apart = blocks.join(clash, "h", "left_semi").select("h", "block").distinct()
        order = Window.partitionBy("h").orderBy("block")
        ranked = cut_lineage(apart.withColumn("tie", F.row_number().over(order)), "clashes")
        keyed = blocks.join(ranked, ["h", "block"], "left").select(
            ROW, "pos", "n", "h", F.coalesce("tie", F.lit(0)).alias("tie"))
        keys = per_hash.where("contents = 1").select("h", F.lit(0).alias("tie")).unionByName(ranked.select("h", "tie"))
    names = _numbered(keys, ["h", "tie"])
    return cut_lineage(keyed.join(names, ["h", "tie"]).select(ROW, "pos", "n", "name"), "named")


def _name_pairs(named: DataFrame) -> DataFrame:
    """One round: adjacent integers of a document become one."""
    even = F.col("pos") % 2 == 0
    pairs = named.groupBy(ROW, F.expr("pos div 2").alias("pos"), F.expr("(n + 1) div 2").alias("n")).agg(
        F.max(F.when(even, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
    pairs = cut_lineage(pairs, "pairs")
    names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
    return cut_lineage(pairs.join(names, ["a", "b"]).select(ROW, "pos", "n", "name"), "named")


def identities(blocks: DataFrame) -> DataFrame:
    """(row, level, name): the one integer of each document, and the round that gave it."""
    rounds = blocks.agg(F.max("n")).first()[0]
    named, done, level = _name_blocks(blocks), [], 0
    while True:
        done.append(named.where("n = 1").select(ROW, F.lit(level).alias("level"), "name"))
        if rounds is None or rounds <= 1:
            break
        named, level, rounds = _name_pairs(named.where("n > 1")), level + 1, (rounds + 1) // 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
                route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: its key, doc_id, keep_id, group_size, kept and text_sha256.

    ``docs`` has to be a stored table (see :func:`with_row_key`); ``route`` is the hash that
    brings equal blocks together, and any function gives the same groups.
    """
    cut = cut_blocks(docs, doc_id, text, block_bytes)
    blocks = cut_lineage(cut.withColumn("h", route(F.col("block"))), "blocks")
    found = cut_lineage(identities(blocks), "identities")
    whole = blocks.where("pos = 0").select(ROW, "doc_id", "sha")
    rows = cut_lineage(found.join(whole, ROW), "documents")
    groups = cut_lineage(
        rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", ROW)).alias("keep"), F.count(F.lit(1)).alias("size")),
        "groups")
    return rows.join(groups, ["level", "name"]).select(
        ROW, "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col(ROW) == F.col(f"keep.{ROW}")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return keep_rows(docs, exact_dedup(docs, doc_id, text).where("kept"))


def op4_exact_dedup(spark, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents")).drop(ROW)


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
           FROM documents),
     g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""
