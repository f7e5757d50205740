"""Best-fit packing of documents into sequences, certified by lower bounds.

A document is its token ids and an end id; only one longer than a sequence is cut, into full
pieces and a shorter last one.  Pieces are dealt to partitions.  A partition packs by best fit
decreasing, and dual feasible functions bound from below how many bins its pieces need at least.
A partition whose count equals its bound is certified; one with a gap gives up its emptiest bins.
What partitions give up is dealt to fewer partitions, where documents of many meet, and packed
again, until one partition holds all that is left.  A partition keeps half of its pieces at least, its fullest bins
first, so the number of rounds is the logarithm of the number of partitions.  Nothing but lengths and keys is shuffled.

A null text has the end id only.  Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.chunk_table import ChunkTable
from unitloom.llm.common import ROW, table, with_row_key
from unitloom.session import cut_lineage

CAPACITY = 2048
#: Pieces a partition packs at once.
PART_PIECES = 100_000
#: Emptiest bins a partition gives up: this many, and this many more for each bin of its gap.
GIVEN_UP, GIVEN_UP_PER_GAP = 1, 8

_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "</w>"
#: Characters that any Unicode version lower-cases and sorts into letters and numbers alike.
_PLAIN = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x17F)]) if len(c.lower()) == 1 and len(c.upper()) == 1 and c != "\u00ad"]


def _plain_cut() -> re.Pattern:
    """``_CUT`` for lower-cased texts of plain characters, which need no Unicode tables."""
    kinds = {kind: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN"}
    return re.compile(_CUT.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]))


def cuts_words_alike(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space and cuts by ``_CUT``, each cut ending in a marked id."""
    import json

    spec = json.loads(tokenizer.to_str())
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    steps = [step["type"] for step in (spec.get("normalizer") or {}).get("normalizers") or []]
    return (
        steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
        and cut[0].get("pattern") == {"Regex": _CUT} and cut[0].get("behavior") == "Removed" and cut[0].get("invert") is True
        and not cut[1].get("use_regex") and spec["model"].get("end_of_word_suffix") == _END)


class WordEncoder:
    """Ids of texts.  A text falls apart into the tokenizer's cuts, and each distinct cut is encoded once.

    Words with other than plain characters are encoded whole.  A tokenizer that cuts otherwise gets
    whole texts, each distinct one once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.tokenizer = Tokenizer.from_str(file.read())
        self.by_cut = cuts_words_alike(self.tokenizer)
        starts = {token.content[0] for token in self.tokenizer.get_added_tokens_decoder().values()}
        plain = "".join(re.escape(c) for c in _PLAIN if c not in starts)
        self.plain_text, self.plain_word = re.compile(f"[ \t\n\r{plain}]*").fullmatch, re.compile(f"[{plain}]*").fullmatch
        # from the start of a word only, and without going back, so a long word is read once
        self.odd_words = re.compile(f"(?<![^ \t\n\r])[{plain}]*+[^ \t\n\r{plain}][^ \t\n\r]*").finditer
        self.cuts = _plain_cut().findall
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith(_END)]] = True
        self.table = ChunkTable(self._chunks if self.by_cut else self._texts)

    def _texts(self, texts):
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]):
        """Ids of chunks; plain ones go many in a call, as the end marks tell them apart."""
        out: list = [None] * len(chunks)
        alone = [i for i, chunk in enumerate(chunks) if not self.plain_word(chunk)]
        odd = set(alone)
        plain = [i for i in range(len(chunks)) if i not in odd] if odd else range(len(chunks))
        groups = [plain[i:i + 1000] for i in range(0, len(plain), 1000)]
        for group, ids in zip(groups, self._texts([" ".join([chunks[i] for i in group]) for group in groups])):
            marks = np.flatnonzero(self.ends[ids]) + 1
            if len(marks) != len(group):
                alone += group
                continue
            start = 0
            for i, end in zip(group, marks.tolist()):
                out[i] = ids[start:end]
                start = end
        for i, ids in zip(alone, self._texts([chunks[i] for i in alone])):
            out[i] = ids
        return out

    def _cut(self, text: str) -> list[str]:
        if self.plain_text(text):
            return self.cuts(text.lower())
        chunks, at = [], 0
        for word in self.odd_words(text):
            chunks += self.cuts(text[at:word.start()].lower())
            chunks.append(word.group())
            at = word.end()
        return chunks + self.cuts(text[at:].lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode([self._cut(text) if self.by_cut else [text] for text in texts])


_ENCODERS: dict[str, WordEncoder] = {}


def pieces_of(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
              capacity: int = CAPACITY, with_ids: bool = False, texts_at_once: int = 256) -> DataFrame:
    """One row per piece: row key, doc_id, piece, start, length and ids_crc32 (and its ids)."""
    keyed = with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"{ROW} long, doc_id long, piece int, start long, length long, ids_crc32 long"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [ROW, "doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        schema, kinds, names = schema + ", ids array<int>", [*kinds, pa.list_(pa.int32())], [*names, "ids"]

    def cut(batches):
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))
        for batch in batches:
            for first in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(first, texts_at_once)
                flat, counts = encoder.encode(part.column(2).to_pylist())
                rows, at = [], 0
                for key, name, count in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), counts.tolist()):
                    ids = np.append(flat[at:at + count], end_id).astype("<u4")
                    at += count
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start:start + capacity]
                        row = (key, name, piece, start, len(own), zlib.crc32(own.tobytes()))
                        rows.append((*row, own.astype(np.int32)) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return keyed.mapInArrow(cut, schema)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Least number of bins for ``counts[length]`` pieces, by dual feasible functions.

    A dual feasible function keeps any set of lengths that fits a bin within one bin, so the sum
    of its values, rounded up, is a bound.  Used are the lengths themselves, the functions that
    count lengths over a threshold as a whole bin and drop those under its complement, and the
    rounding functions for one to fifty parts.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return 0
    n = counts[lengths].astype(object)
    best = -(-int((lengths * n).sum()) // capacity)
    for threshold in sorted({int(x) for x in lengths if 2 * x <= capacity} | {capacity // 2}):
        value = np.where(lengths > capacity - threshold, capacity, np.where(lengths < threshold, 0, lengths))
        best = max(best, -(-int((value * n).sum()) // capacity))
    for parts in range(1, 51):
        scaled = (parts + 1) * lengths
        value = np.where(scaled % capacity == 0, lengths * parts, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * n).sum()) // (capacity * parts)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, each to the fullest bin that still has room."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        at = bisect_left(rooms, need)
        if at == len(rooms):
            room, number = capacity, opened
            opened += 1
        else:
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[i], offsets[i] = number, capacity - room
        room -= need
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(number)
    return bins, offsets


def _packer(capacity: int, last: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([ROW, "piece"], kind="stable")
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        gap = n - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n)
        again = np.zeros(n, bool)
        if not last:
            loose = np.argsort(fill, kind="stable")[:GIVEN_UP + (GIVEN_UP_PER_GAP * gap if gap else 0)]
            loose = loose[fill[loose] < capacity]
            # at most half of the pieces go on, so rounds come to an end whatever the lengths are
            held = np.cumsum(np.bincount(bins, minlength=n)[loose])
            again[loose[held <= len(rows) // 2]] = True
        return pd.DataFrame({ROW: rows[ROW], "piece": rows["piece"], "length": lengths, "part": rows["part"], "bin": bins,
                             "offset": offsets, "again": again[bins]})
    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """(row key, piece, sequence_id, offset) of each piece of a stored table of pieces."""
    full = pieces.where(F.col("length") == capacity)
    done = [full.select(ROW, "piece", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(F.col("length") < capacity).select(ROW, "piece", "length")
    step = 0
    while True:
        step += 1
        count = rest.count()
        if not count:
            break
        parts = -(-count // part_pieces)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64(ROW, "piece", F.lit(step)), F.lit(parts)).cast("long"))
        packed = cut_lineage(dealt.groupBy("part").applyInPandas(
            _packer(capacity, parts == 1),
            f"{ROW} long, piece int, length long, part long, bin long, offset long, again boolean"), "packed")
        if step >= 32:
            raise ValueError("more rounds than sequence ids have room for")
        number = F.lit(step).cast("long") * (1 << 58) + F.col("part") * (1 << 30) + F.col("bin")
        done.append(packed.where("NOT again").select(ROW, "piece", number.alias("sequence_id"), "offset"))
        rest = packed.where("again").select(ROW, "piece", "length")
        if parts == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0,
                     capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each piece with its place: row key, doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset."""
    pieces = cut_lineage(pieces_of(docs, path, doc_id, text, end_id, capacity, with_ids), "pieces")
    return pieces.join(pack(pieces, capacity), [ROW, "piece"])


def op9_bestfit_packing(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop(ROW)
