"""Exact top-k search by inner product over a bit-sliced index.

A component x is quantised to floor(scale * x).  Candidates are cut into blocks of some
thousand rows; of a block, slice (d, b) is a bitmap with a bit per row: bit b of attribute d,
counted from the block's least value of d.  The score of a query against a whole block is then
bitmap arithmetic: slice (d, b) is added with weight b + a for each bit a of the query's
component (of its complement where the component is negative), three bitmaps of a weight
becoming one of that weight and one of the next until one is left per weight.  The best rows
are picked from the most significant slice downward, and the rows tied at the boundary are
resolved by id, so a block's answer is exact, and so is the best of all blocks' answers.

Queries come in chunks and meet every block, as a stated query set.  Vectors that are null, or
hold nulls or non-finite components take no part; every other does, however large its components
are, as integers too large for a machine word are Python's.  A score that is returned has to fit 64 bits,
and is an error if it does not.  Vectors meet those of their own length only.  A query is every row whose id the divisor divides; rows that
repeat an id are candidates of their own and queries of their own, but an id never meets itself.
A null id takes no part.  An empty vector scores 0.
"""

from __future__ import annotations

import math
import operator
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from unitloom.llm.common import table
from unitloom.session import cut_lineage

BLOCK_ROWS = 8192
CHUNK_QUERIES = 256
#: Sums below this cannot leave a machine word.
WORD = 1 << 62


def integers(rows: pd.Series, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; as Python integers if some would not fit a machine word."""
    x = np.array(rows.tolist(), dtype=np.float64).reshape(len(rows), dims)
    if float(np.abs(x).max(initial=0)) < WORD / scale:
        return np.floor(x * scale).astype(np.int64)
    # a double of 2**52 or more is whole, and its product might not be a double
    whole = [math.floor(v * scale) if abs(v) < 1 << 52 else int(v) * scale for v in x.ravel().tolist()]
    out = np.empty(len(whole), dtype=object)
    out[:] = whole
    return out.reshape(x.shape)


def usable_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, x): vectors that take part, as doubles."""
    doubles = F.transform(F.col(embedding), lambda x: x.cast("double"))
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), doubles.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(usable, F.lit(False)))
        .select("vec_id", F.size("x").alias("dim"), "x"))


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows x attributes -> bitmaps [attribute, bit, word], rows from the lowest bit of word 0."""
    rows, dims = values.shape
    words = -(-rows // 64)
    out = np.zeros((dims, width, words * 8), dtype=np.uint8)
    for bit in range(width):
        packed = np.packbits(((values >> bit) & 1).astype(np.uint8), axis=0, bitorder="little")
        out[:, bit, :packed.shape[0]] = packed.T
    return out.view(np.uint64)


def build_index(rows: pd.DataFrame) -> dict:
    """A block's sorted ids, each attribute's least value, and the slices as bytes."""
    rows = rows.sort_values("vec_id", kind="stable")
    dims = int(rows["dim"].iloc[0])
    values = np.stack(rows["q"].tolist()).reshape(len(rows), dims)
    values = values if values.dtype == object else values.astype(np.int64)
    least = values.min(axis=0) if dims else np.zeros(0, np.int64)
    values = values - least
    width = max(1, int(values.max(initial=0)).bit_length())
    return {"ids": rows["vec_id"].to_numpy(np.int64), "least": least, "width": width, "slices": _bits(values, width)}


def add_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices, least significant first, of sum over d of |query[d]| times attribute d or its complement."""
    width = slices.shape[1]
    full = np.where((query < 0)[:, None, None], ~slices, slices)
    size = np.abs(query)
    waiting: dict[int, list[np.ndarray]] = {}
    for a in range(int(size.max(initial=0)).bit_length()):
        chosen = full[((size >> a) & 1).astype(bool)]
        if len(chosen):
            for b in range(width):
                waiting.setdefault(a + b, []).append(chosen[:, b])
    sums, weight = [], 0
    while waiting:
        stack = waiting.pop(weight, None)
        if stack is None:
            sums.append(np.zeros(slices.shape[2], np.uint64))
            weight += 1
            continue
        left = np.concatenate(stack)
        carries = []
        while len(left) > 1:
            if len(left) == 2:
                carries.append((left[0] & left[1])[None])
                left = (left[0] ^ left[1])[None]
                break
            third = len(left) // 3
            x, y, z = left[:third], left[third:2 * third], left[2 * third:3 * third]
            half = x ^ y
            carries.append((x & y) | (half & z))
            left = np.concatenate([half ^ z, left[3 * third:]])
        if carries:
            waiting.setdefault(weight + 1, []).append(np.concatenate(carries))
        sums.append(left[0])
        weight += 1
    return sums


def top_rows(sums: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest sums among ``valid`` rows, ties to the first rows."""
    sure, tied = np.zeros_like(valid), valid.copy()
    for plane in reversed(sums):
        high = tied & plane
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            tied = high
        else:
            sure = sure | high
            tied = tied & ~plane
            if n == k:
                tied = np.zeros_like(valid)
                break
    chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    missing = k - len(chosen)
    if missing > 0:
        edge = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
        chosen = np.concatenate([chosen, edge[:missing]])
    return chosen


def search_block(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Lists (query row, vec_id, score): each query's best rows of a block; a score is exact, however large."""
    ids, slices, least, width = index["ids"], index["slices"], index["least"], index["width"]
    everyone = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
    valid = np.zeros(slices.shape[2] * 8, np.uint8)
    valid[:len(everyone)] = everyone
    valid = valid.view(np.uint64)
    top = (1 << width) - 1
    found = ([], [], [])
    for i, (own, query) in enumerate(zip(query_ids, queries)):
        mask = valid
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        if high > low:
            mask = valid.copy()
            for at in range(low, high):
                mask[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        sums = add_slices(slices, query)
        # complements count from the top: |q| * (top - u) = |q| * top + q * u
        exact, lows = query.tolist(), least.tolist()
        shift = sum(map(operator.mul, exact, lows)) + top * sum(q for q in exact if q < 0)
        rows = top_rows(sums, mask, k)
        score = np.full(len(rows), shift, dtype=np.int64 if abs(shift) < WORD and len(sums) < 62 else object)
        for weight, plane in enumerate(sums):
            bit = (plane[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
            score += bit.astype(np.int64).astype(score.dtype) << weight
        found[0].extend([i] * len(rows))
        found[1].extend(ids[rows].tolist())
        found[2].extend(score.tolist())
    return found


def _pack_block(scale: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        index = build_index(rows.assign(q=list(integers(rows["x"], int(rows["dim"].iloc[0]), scale))))
        return pd.DataFrame({
            "block": [rows["block"].iloc[0]], "dim": [rows["dim"].iloc[0]], "ids": [index["ids"].tobytes()],
            "least": [pickle.dumps(index["least"])], "width": [index["width"]], "slices": [index["slices"].tobytes()]})
    return pack


def _pack_chunk(scale: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        matrix = integers(rows["x"], int(rows["dim"].iloc[0]), scale)
        return pd.DataFrame({
            "chunk": [rows["chunk"].iloc[0]], "q_dim": [rows["dim"].iloc[0]], "query_keys": [rows["key"].to_numpy(np.int64).tobytes()],
            "query_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "queries": [pickle.dumps(matrix)]})
    return pack


def _read(slot, kind):
    return np.frombuffer(slot.as_py(), dtype=kind)


def _search(k: int):
    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                dim, width = row["dim"].as_py(), row["width"].as_py()
                ids = _read(row["ids"], np.int64)
                words = -(-len(ids) // 64)
                index = {"ids": ids, "least": pickle.loads(row["least"].as_py()), "width": width,
                         "slices": _read(row["slices"], np.uint64).reshape(dim, width, words)}
                keys, own = _read(row["query_keys"], np.int64), _read(row["query_ids"], np.int64)
                at, vec, exact = search_block(index, own, pickle.loads(row["queries"].as_py()), k)
                # a score that does not fit is wide, and passed on as the nearest number that does
                score = [min(max(value, -(1 << 63)), (1 << 63) - 1) for value in exact]
                wide = [a != b for a, b in zip(exact, score)]
                yield pa.RecordBatch.from_pydict(
                    {"key": keys[at] if at else [], "query_id": own[at] if at else [], "vec_id": vec, "score": score, "wide": wide},
                    schema=pa.schema([*[(name, pa.int64()) for name in ("key", "query_id", "vec_id", "score")], ("wide", pa.bool_())]))
    return search


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", divisor: int = 50, k: int = 5,
          scale: int = 256, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, fewer if there are fewer."""
    usable = cut_lineage(
        usable_vectors(vectors, vec_id, embedding).withColumn("key", F.monotonically_increasing_id()), "vectors")
    sizes = usable.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % divisor == 0, 1)).alias("asked"))
    blocks_of = F.ceil(F.col("n") / block_rows).cast("int")
    sizes = cut_lineage(sizes.select(
        "dim", blocks_of.alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("asked") / chunk_queries)).cast("int").alias("chunks")),
        "sizes")
    dealt = usable.join(sizes, "dim").withColumn("deal", F.xxhash64("key"))
    index = (
        dealt.withColumn("block", F.pmod("deal", F.col("blocks").cast("long")).cast("int"))
        .groupBy("dim", "block").applyInPandas(_pack_block(scale), "block int, dim int, ids binary, least binary, width int, slices binary"))
    chunks = (
        dealt.where(F.col("vec_id") % divisor == 0).withColumn("chunk", F.pmod("deal", F.col("chunks").cast("long")).cast("int"))
        .groupBy("dim", "chunk").applyInPandas(_pack_chunk(scale), "chunk int, q_dim int, query_keys binary, query_ids binary, queries binary"))
    asked = (
        chunks.join(sizes.withColumnRenamed("dim", "s_dim"), F.col("q_dim") == F.col("s_dim"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("s_dim", "blocks", "chunks"))
    met = asked.join(index, (F.col("q_dim") == F.col("dim")) & (F.col("q_block") == F.col("block")))
    even = met.repartition(F.col("q_dim"), F.col("q_block"), F.col("chunk"))
    found = even.mapInArrow(_search(k), "key long, query_id long, vec_id long, score long, wide boolean")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    # a wide score comes out among the best only if it is one of them, or all before it are wide too
    score = F.when(F.col("wide"), F.raise_error(F.lit("a score passes 64 bits")).cast("long")).otherwise(F.col("score"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", score.alias("score")))


def op1_topk_search(spark, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
