"""Alignment of two tokenizers over a corpus, in Arrow.

Both tokenizers encode a space and the text; every token stands for some of these bytes.  Offsets where
tokens of both end cut them into groups, and two tokens are linked where their bytes overlap.  How often a pair of ids
is linked in the whole corpus then says, for every link of a document, whether it is its second id's best.

All of it is Arrow: lists of ids are flattened with their parent indices, cumulative sums of token lengths that
start anew in each document give ends, a full outer hash join on (document, end) brings the ends of both
tokenizers together, and each row that comes out is one link: the stretch of bytes up to its end lies in one token of
either side, which is the next that ends there or later.  Pairs are counted by document and
by slice, some megabytes of text, and Spark adds up the slices.

Texts are encoded once.  A document keeps the places of its pairs in the slice's list of pairs, and only that
list, not the links, meets the corpus's counts: a slice has one row per pair, however often texts repeat it, so
a frequent pair brings one row per slice, and the join's sides are written tables, whose hot keys Spark splits.  Counts come
back to their slice in one row per pair.  What is sent to all tasks is the highest count per second id, at most
one row per entry of that vocabulary.

A null or empty text, and one whose bytes either tokenizer does not give back (a piece's marker in the text, for
one), has no tokens: zeros, and '' for its groups.  Rows that repeat an id are documents of their own and an empty table gives no rows.  A text
is encoded whole; slices are bounded by bytes, and a longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.common import ROW, table, with_row_key
from unitloom.llm.pieces import MARK, Codec, chunks_of
from unitloom.session import cut_lineage

#: Bytes of text whose pairs share a list, and that are joined at once.
SLICE_BYTES, JOIN_BYTES = 16_000_000, 2_000_000
# Fixed value: how byte-level tokenizers cut texts before merges.
BYTE_LEVEL_CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters are cut alike by any version of Unicode.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ſ]*").fullmatch


def byte_level_bytes(entry: str, byte_of: dict[str, int]) -> bytes:
    return bytes(byte_of[c] for c in entry)


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1 stands for itself, other bytes for 256 and on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def _lists(flat: np.ndarray, counts) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.asarray(flat, np.int32)))


class ByteLevel:
    """A byte-level tokenizer; special strings in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True
        spec, byte_of = json.loads(text), byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        special = {token["content"] for token in spec["added_tokens"]}
        known = {i: byte_level_bytes(entry, byte_of) for entry, i in vocabulary.items() if entry not in special}
        self.bytes = pa.array([known.get(i, b"") for i in range(self.tokenizer.get_vocab_size())], pa.binary())
        self.ranked = self._ranked(spec, known)

    def _ranked(self, spec: dict, known: dict[int, bytes]):
        """An encoder by ranks, if ids ascend as the merges do and texts are cut in the usual way."""
        import tiktoken

        vocabulary, cut = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        merged = [vocabulary["".join(merge.split(" ") if isinstance(merge, str) else merge)] for merge in spec["model"]["merges"]]
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and spec.get("normalizer") is None
        if not usual or spec["model"].get("ignore_merges") or any(a >= b for a, b in zip(merged, merged[1:])):
            return None
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_CUT, mergeable_ranks={b: i for i, b in known.items()}, special_tokens={})

    def encode(self, texts: list[str]) -> pa.ListArray:
        out = []
        for text in texts:
            if self.ranked is not None and _PLAIN(text):
                out.append(self.ranked.encode_to_numpy(text, disallowed_special=()))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
        return _lists(np.concatenate(out) if out else np.zeros(0), [len(ids) for ids in out])


class Pieces:
    """A sentencepiece model, which puts the leading space itself; words are segmented once."""

    def __init__(self, path: str):
        codec = Codec(path)
        self.table, self.chunked, model = codec.ids, codec.chunked, codec.model
        self.bytes = pa.array([
            bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(model.get_piece_size())], pa.binary())

    def encode(self, texts: list[str]) -> pa.ListArray:
        return _lists(*self.table.encode([chunks_of(text) if self.chunked else [text] for text in texts]))


def _flat(lists: pa.ListArray, lengths: pa.Array) -> pa.Table:
    """(doc, end, id, at) of each token: its document, the bytes up to its end there, and its place in the flat list."""
    ids, parents = lists.flatten(), pc.list_parent_indices(lists)
    upto = pc.cumulative_sum_checked(pc.cast(pc.take(lengths, ids), pa.int64()))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), upto]), lists.offsets.slice(0, len(lists)))
    return pa.table({"doc": pc.cast(parents, pa.int64()), "end": pc.subtract(upto, pc.take(before, parents)), "id": ids})


def _joined_bytes(lists: pa.ListArray, entries: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pc.take(entries, lists.flatten())), b"")


def _cut(ends: pa.Array, values: pa.Array, separator: str) -> pa.Array:
    """``values`` joined up to each of ``ends``, places in the flat list."""
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(ends, pa.int32())])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), separator)


def _total(flags: pa.Array) -> pa.Array:
    return pc.cumulative_sum(pc.cast(flags, pa.int64()))


def align(texts: list[str], a, b) -> tuple[pa.Table, pa.Table]:
    """Counts and groups of each text that has tokens, and its distinct pairs of linked ids.

    The first table has doc (place in ``texts``), n_a, n_b, n_groups, n_links and groups; the second doc, pair
    (a's id times the size of b's vocabulary, and b's id) and times.
    """
    wanted = pa.array([b" " + text.encode() for text in texts], pa.binary())
    lists = [a.encode([" " + text for text in texts]), b.encode(texts)]
    whole = pc.and_(*[pc.equal(_joined_bytes(ids, side.bytes), wanted) for ids, side in zip(lists, (a, b))])
    places = pc.indices_nonzero(pc.and_(whole, pc.greater(pc.binary_length(wanted), 1)))
    lists = [ids.take(places) for ids in lists]
    sides = [_flat(ids, pc.binary_length(side.bytes)) for ids, side in zip(lists, (a, b))]
    links = sides[0].join(sides[1], keys=["doc", "end"], join_type="full outer", left_suffix="_a", right_suffix="_b", use_threads=False)
    links = links.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    doc, id_a, id_b = (links[name].combine_chunks() for name in ("doc", "id_a", "id_b"))
    ends_a, ends_b = pc.is_valid(id_a), pc.is_valid(id_b)
    common = pc.and_(ends_a, ends_b)
    # the last row of a document is an end of both, so nothing is filled in from the next
    first, second = pc.fill_null_backward(id_a), pc.fill_null_backward(id_b)
    pair = pc.add(pc.multiply(pc.cast(first, pa.int64()), len(b.bytes)), pc.cast(second, pa.int64()))
    pairs = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    per_doc = pa.table({"doc": doc, "common": pc.cast(common, pa.int64())}).group_by("doc", use_threads=False).aggregate(
        [("common", "sum"), ("common", "count")]).sort_by("doc")
    groups = pc.binary_join_element_wise(*[
        _cut(pc.filter(_total(ends), common), pc.cast(side["id"].combine_chunks(), pa.string()), ",")
        for ends, side in zip((ends_a, ends_b), sides)], "|")
    n_groups = per_doc["common_sum"].combine_chunks()
    counts = pa.table({
        "doc": places.cast(pa.int64()), "n_a": pc.cast(pc.list_value_length(lists[0]), pa.int64()),
        "n_b": pc.cast(pc.list_value_length(lists[1]), pa.int64()), "n_groups": n_groups, "n_links": per_doc["common_count"].combine_chunks(),
        "groups": _cut(pc.cumulative_sum(n_groups), groups, ";"),
    })
    return counts, pa.table({"doc": pc.take(places.cast(pa.int64()), pairs["doc"]), "pair": pairs["pair"], "times": pairs["count_all"]})


_DOC = [("slice", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string()), ("places", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
_PAIR = [("place", pa.int32()), ("pair", pa.int64()), ("links", pa.int64())]
_STORED = ("slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<int>,"
           " place int, pair long, links long")
_SCHEMA = pa.schema(_DOC + _PAIR)


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(field.name, pa.nulls(n, field.type)) for field in _SCHEMA], schema=_SCHEMA)


def _slice_rows(key: int, doc_ids: list, tables: list[tuple[int, pa.Table, pa.Table]]):
    """Rows of a slice: its documents, and its pairs with how many links they have in the slice."""
    n = len(doc_ids)
    counts = pa.concat_tables([t.set_column(0, "doc", pc.add(t["doc"], start)) for start, t, _ in tables])
    pairs = pa.concat_tables([t.set_column(0, "doc", pc.add(t["doc"], start)) for start, _, t in tables])
    known = pairs.group_by("pair", use_threads=False).aggregate([("times", "sum")])
    distinct = known["pair"].combine_chunks()
    held = pairs.group_by("doc", use_threads=False).aggregate([("pair", "count")])
    pairs = pairs.sort_by("doc") if len(tables) > 1 else pairs
    sizes = np.zeros(n, np.int64)
    sizes[held["doc"].to_numpy()] = held["pair_count"].to_numpy()
    order = np.argsort(pairs["doc"].to_numpy(), kind="stable")
    places = pc.index_in(pairs["pair"].combine_chunks(), value_set=distinct).to_numpy()[order]
    times = pairs["times"].to_numpy()[order]
    columns = {"slice": pa.array(np.full(n, key), pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()),
               "places": _lists(places, sizes), "times": _lists(times, sizes)}
    at = counts["doc"].to_numpy()
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        full = np.zeros(n, np.int64)
        full[at] = counts[name].to_numpy()
        columns[name] = pa.array(full)
    digests = [""] * n
    for i, groups in zip(at.tolist(), counts["groups"]):
        digests[i] = hashlib.sha256(groups.as_buffer()).hexdigest()
    columns["groups_sha256"] = pa.array(digests, pa.string())
    yield _batch(columns, n)
    m = len(distinct)
    if m:
        yield _batch({"slice": pa.array(np.full(m, key), pa.int64()), "place": pa.array(np.arange(m), pa.int32()), "pair": distinct,
                      "links": known["times_sum"].combine_chunks()}, m)


_SIDES: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def aligned_slices(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
                   slice_bytes: int = SLICE_BYTES, join_bytes: int = JOIN_BYTES) -> DataFrame:
    """Documents and pairs of each slice; a slice is named by the row key of its first document."""
    keyed = with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def read(batches):
        sides = _SIDES.get((path_a, path_b)) or _SIDES.setdefault((path_a, path_b), (ByteLevel(path_a), Pieces(path_b)))
        key, doc_ids, tables, size = None, [], [], 0

        def parts():
            """Runs of rows that are joined at once."""
            for batch in batches:
                bounds = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) + 1)])
                start = 0
                while start < batch.num_rows:
                    end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + join_bytes, "right")) - 1)
                    yield batch.slice(start, end - start), int(bounds[end] - bounds[start])
                    start = end

        for part, n_bytes in parts():
            if doc_ids and size + n_bytes > slice_bytes:
                yield from _slice_rows(key, doc_ids, tables)
                doc_ids, tables, size = [], [], 0
            if not doc_ids:
                key = part.column(0)[0].as_py()
            tables.append((len(doc_ids), *align(part.column(2).to_pylist(), *sides)))
            doc_ids += part.column(1).to_pylist()
            size += n_bytes
        if doc_ids:
            yield from _slice_rows(key, doc_ids, tables)

    return cut_lineage(keyed.mapInArrow(read, _STORED), "slices")


def pair_counts(slices: DataFrame, size_b: int) -> DataFrame:
    """(pair, total, best): links of each pair in the corpus, and whether no pair of its second id has more."""
    totals = cut_lineage(slices.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("links").alias("total")), "totals")
    second = F.pmod("pair", F.lit(size_b)).alias("second")
    # a row per entry of the second vocabulary at most, so it may be sent to all
    highest = F.broadcast(totals.groupBy(second).agg(F.max("total").alias("highest")))
    return totals.select("*", second).join(highest, "second").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def _with_counts(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of a slice with the sums over their links, from the counts of the slice's pairs."""
    docs, counts = docs.combine_chunks(), counts.sort_by("place").combine_chunks()
    n = docs.num_rows
    places = docs["places"].combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
    flat, parents = places.flatten(), pc.list_parent_indices(places)
    times = pc.cast(docs["times"].combine_chunks().flatten(), pa.int64())
    totals = pc.multiply_checked(pc.take(counts["total"].combine_chunks(), flat), times)
    best = pc.multiply(pc.cast(pc.take(counts["best"].combine_chunks(), flat), pa.int64()), times)
    sums = pa.table({"doc": parents, "total": totals, "best": best}).group_by("doc", use_threads=False).aggregate([("total", "sum"), ("best", "sum")])
    full = {name: np.zeros(n, np.int64) for name in ("best_sum", "total_sum")}
    for name, values in full.items():
        values[sums["doc"].to_numpy()] = sums[name].to_numpy()
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(full["best_sum"])).append_column("count_sum", pa.array(full["total_sum"])).append_column(
        "groups_sha256", docs["groups_sha256"])


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
                      slice_bytes: int = SLICE_BYTES, join_bytes: int = JOIN_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of a stored table."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    slices = aligned_slices(docs, path_a, path_b, doc_id, text, slice_bytes, join_bytes)
    counts = cut_lineage(pair_counts(slices, size_b), "counts")
    known = slices.where("pair IS NOT NULL").select("slice", "place", "pair").join(counts, "pair").select(F.col("slice").alias("of"), "place", "total", "best")
    texts = slices.where("pair IS NULL").drop("place", "pair", "links")
    return texts.groupBy("slice").cogroup(known.groupBy("of")).applyInArrow(
        _with_counts, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_tokenizer_alignment(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return aligned_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
