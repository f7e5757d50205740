"""Substring dedup by difference-cover anchors.

A window is so many consecutive words.  Anchors are shorter windows at the positions of a document
that a difference cover holds, modulo its period: for any two positions some shift below the period
moves both onto the cover, so two equal windows share an anchor at the same shift inside them.  Anchors
that lie in one document only are dropped; windows without a shared anchor have no equal elsewhere.
The rest extend from the anchor to the whole window, and of equal windows the smallest doc_id is found.
A word is removed if a window over it also starts in a document with a smaller id.

What a batch of documents repeats is settled in the batch, which sends each anchor and each window
on once; so a passage that a third of all rows holds reaches a task once per batch.  Sorted rows are
read as a stream: no task gathers a group.  Shared anchors and repeated windows are written, which frees the shuffles
they come from; texts are shuffled for each of the two.

Windows are told apart by 96 bits of hash.  Null texts have no words.  A null id is smaller than any other.  Rows that repeat an id do not
remove each other's words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.common import ROW, sha256_hex, table, with_row_key
from unitloom.session import cut_lineage

WINDOW = 13
#: Every difference modulo 7 is one between two of these.
PERIOD, COVER = 7, (1, 2, 4)
BATCH_BYTES = 16 << 20
_NULL_ID = -(1 << 63)
_LOW = (1 << 32) - 1


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHash()
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    total = np.full(len(starts), mixed(np.array([seed], np.uint64))[0], np.uint64)
    for i in range(size):
        total = mixed(total * _MIX[2] + words[starts + i])
    return total


def covered_starts(n_words: int, window: int) -> np.ndarray:
    """Places of anchors inside documents that have a window at all."""
    if n_words < window:
        return np.zeros(0, np.int64)
    places = np.arange(n_words - (window - PERIOD + 1) + 1)
    return places[np.isin(places % PERIOD, COVER)]


def anchors_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a document's anchors; 48 bits, as they only choose windows to compare."""
    places = covered_starts(len(words), window)
    hashes = window_hashes(words, places, window - PERIOD + 1, 1) & np.uint64((1 << 48) - 1)
    return places, hashes.view(np.int64)


def _parts(batch, column: int):
    """Slices of a batch with a bounded number of characters (one row at least)."""
    start, held = 0, 0
    texts = batch.column(column)
    for i in range(batch.num_rows):
        held += len(texts[i].as_buffer())
        if held > BATCH_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _emit_anchors(window: int):
    def emit(batches):
        for whole in batches:
            for batch in _parts(whole, 2):
                hashes, rows = [], []
                for row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    found = np.unique(anchors_of(word_hashes(text), window)[1])
                    hashes.append(found)
                    rows.append(np.full(len(found), row, np.int64))
                h, row = np.concatenate(hashes), np.concatenate(rows)
                order = np.argsort(h, kind="stable")
                new = np.ones(len(h), bool)
                new[order[1:]] = h[order[1:]] != h[order[:-1]]
                shared = np.zeros(len(h), bool)
                shared[order[1:]] = ~new[order[1:]]
                shared[order[:-1]] |= ~new[order[1:]]
                # documents stay in order, so that all columns but the hashes compress well
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h[new], h[shared]])), pa.array(np.concatenate([row[new], row[shared]])),
                     pa.array(np.concatenate([np.zeros(new.sum(), bool), np.ones(shared.sum(), bool)]))],
                    names=["h", ROW, "known"])
    return emit


def _shared_anchors(batches):
    """Of rows sorted by hash: those whose hash another document has too."""
    held = None
    for batch in batches:
        h, row, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(row[known]), pa.array(h[known])], names=[ROW, "h"])
        h, row = h[~known], row[~known]
        if not len(h):
            continue
        # the last row of a batch waits for the next; a row that was given out is marked
        if held is not None:
            h, row = np.concatenate([[held[0]], h]), np.concatenate([[held[1]], row])
        same = h[1:] == h[:-1]
        out = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if held is not None and held[2]:
            out[0] = False
        yield pa.RecordBatch.from_arrays([pa.array(row[out]), pa.array(h[out])], names=[ROW, "h"])
        held = (h[-1], row[-1], bool(out[-1]) or (len(h) == 1 and held is not None and held[2]))


def _emit_windows(window: int):
    def emit(batches):
        for whole in batches:
            for batch in _parts(whole, 2):
                columns = ([], [], [], [], [])
                for row, doc, text, shared in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    words = word_hashes(text)
                    places, hashes = anchors_of(words, window)
                    places = places[np.isin(hashes, np.array(shared, np.int64))]
                    # a window holds an anchor that starts less than a period after it
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, np.maximum(places - PERIOD + 1, 0), 1)
                    np.add.at(marks, places + 1, -1)
                    starts = np.flatnonzero(np.cumsum(marks)[:len(words) - window + 1] > 0)
                    columns[0].append(window_hashes(words, starts, window, 2))
                    columns[1].append(window_hashes(words, starts, window, 3) >> np.uint64(32))
                    columns[2].append(np.full(len(starts), _NULL_ID if doc is None else doc, np.int64))
                    columns[3].append(np.full(len(starts), row, np.int64))
                    columns[4].append(starts)
                h1, h2, doc, row, place = (np.concatenate(c) for c in columns)
                order = np.lexsort((doc, h2, h1))
                s1, s2, by_key = h1[order], h2[order], doc[order]
                new = np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])[:len(s1)]
                least = by_key[np.maximum.accumulate(np.where(new, np.arange(len(s1)), 0))] if len(s1) else by_key
                gone = np.zeros(len(s1), bool)
                gone[order] = by_key > least
                # what is settled needs no hash; its document's key spreads it
                h1 = np.where(gone, mixed(row.view(np.uint64)), h1)
                h2, doc = np.where(gone, np.uint64(0), h2), np.where(gone, 0, doc)
                # one column for the second hash and the place: what changes from row to row lies together
                placed = (place.astype(np.uint64) << np.uint64(32)) | h2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(placed.view(np.int64)), pa.array(doc), pa.array(row), pa.array(gone)],
                    names=["h1", "placed", "doc", ROW, "gone"])
    return emit


def _repeated_windows(batches):
    """Of rows sorted by hashes and id: windows that a smaller id has too."""
    last = None
    for batch in batches:
        h1, placed, doc, row, gone = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        h2, place = placed & _LOW, (placed >> 32).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(row[gone]), pa.array(place[gone])], names=[ROW, "place"])
        h1, h2, doc, row, place = (c[~gone] for c in (h1, h2, doc, row, place))
        if not len(h1):
            continue
        same = last is not None and (h1[0], h2[0]) == last[:2]
        new = np.concatenate([[not same], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        least = np.where(first >= 0, doc[np.maximum(first, 0)], last[2] if same else 0)
        out = doc > least
        last = (h1[-1], h2[-1], least[-1])
        yield pa.RecordBatch.from_arrays([pa.array(row[out]), pa.array(place[out])], names=[ROW, "place"])


def _keep_words(window: int):
    def keep(batches):
        for batch in batches:
            rows = ([], [], [])
            for text, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.encode().split()
                lost = np.zeros(len(words) + 1, np.int64)
                if places:
                    np.add.at(lost, np.array(places), 1)
                    np.add.at(lost, np.array(places) + window, -1)
                lost = np.cumsum(lost)[:len(words)] > 0
                rows[0].append(len(words))
                rows[1].append(int(lost.sum()))
                rows[2].append(b" ".join([w for w, gone in zip(words, lost.tolist()) if not gone]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())],
                names=[ROW, "doc_id", "n_words", "n_removed", "kept"])
    return keep


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(row key, doc_id, n_words, n_removed, kept) of each row of a stored table; ``kept`` joins the words that stay.

    ``window`` has to be at least the period of the cover.
    """
    if window < PERIOD:
        raise ValueError(f"a window needs at least {PERIOD} words")
    texts = with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    anchors = (
        texts.mapInArrow(_emit_anchors(window), f"h long, {ROW} long, known boolean")
        .repartition(F.when(F.col("known"), F.xxhash64(ROW)).otherwise(F.col("h"))).sortWithinPartitions("h").mapInArrow(_shared_anchors, f"{ROW} long, h long"))
    # a step that is written leaves no shuffle behind, so anchors, windows and texts do not lie on disk together
    shared = cut_lineage(anchors, "anchors").groupBy(ROW).agg(F.collect_list("h").alias("shared"))
    windows = (
        texts.hint("merge").join(shared, ROW).select(ROW, "doc_id", "text", "shared")
        .mapInArrow(_emit_windows(window), f"h1 long, placed long, doc long, {ROW} long, gone boolean")
        .repartition("h1").sortWithinPartitions("h1", F.col("placed").bitwiseAND(F.lit(_LOW)), "doc").mapInArrow(_repeated_windows, f"{ROW} long, place int"))
    repeated = cut_lineage(windows, "windows").groupBy(ROW).agg(F.collect_list("place").alias("places"))
    return texts.hint("merge").join(repeated, ROW, "left").select(ROW, "doc_id", "text", "places").mapInArrow(
        _keep_words(window), f"{ROW} long, doc_id long, n_words long, n_removed long, kept string")


def op6_substring_dedup(spark, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, i, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
m AS (SELECT hash(g) AS h, min(doc_id) AS first FROM x GROUP BY hash(g)),
c AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 13)) AS i FROM x JOIN m ON hash(x.g) = m.h AND m.first < x.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT t.doc_id, len(t.w) AS n_words, len(coalesce(r.gone, [])) AS n_removed,
             CASE WHEN r.gone IS NULL THEN array_to_string(t.w, ' ') ELSE
             (SELECT coalesce(string_agg(u.word, ' ' ORDER BY u.i), '') FROM (SELECT unnest(t.w) AS word, unnest(range(1, len(t.w) + 1)) AS i) u
              WHERE NOT list_contains(r.gone, u.i)) END AS kept
      FROM t LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM k
"""
