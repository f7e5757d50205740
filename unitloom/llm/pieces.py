"""SentencePiece encoding and decoding by a table of distinct chunks.

A space is written as a marker, and a text gets one marker in front.  Where no piece of the model
has a marker after another character, no merge crosses from a character to a marker, so the
text falls apart into chunks, each a run of markers with the characters up to the next run.  Each
distinct chunk is segmented once, and the ids of a text are joined by position.  A model with
pieces that cross, or another normalisation, gets whole texts instead, each distinct one once.

The table belongs to a task's Python worker and starts anew when it is large, so its memory is
bounded; a table of the whole corpus would move every word through a shuffle to save little.

Null counts as empty and an empty text has only the end id.  Rows that repeat an id are rows of
their own.  A marker in the text counts as a space, as it does in the library.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.chunk_table import ChunkTable
from unitloom.llm.common import ROW, sha256_hex, table, with_row_key

MARK = "▁"
_CHUNK = re.compile(r" +[^ ]*")


def splits_at_markers(model) -> bool:
    """Whether no piece of the model has a marker after another character, so chunks are independent."""
    return not any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))


def chunks_of(text: str) -> list[str]:
    """The text with a marker in front, cut before each run of markers; spaces stand for markers."""
    return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def chunk_encoder(model):
    """Ids of chunks: the library puts the first marker itself."""
    lone = model.piece_to_id(MARK)

    def encode(chunks: list[str]) -> list[list[int]]:
        found = model.encode([chunk[1:] for chunk in chunks], num_threads=1)
        return [ids if len(chunk) > 1 else [lone] for chunk, ids in zip(chunks, found)]
    return encode


class Codec:
    """Encodes and decodes lists of texts with one model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            proto = file.read()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = sentencepiece_model_pb2.ModelProto.FromString(proto).normalizer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.chunked = plain and splits_at_markers(self.model)
        self.ids = ChunkTable(chunk_encoder(self.model) if self.chunked else lambda texts: self.model.encode(texts, num_threads=1))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of each text's, end id included."""
        cut = chunks_of if self.chunked else lambda text: [text]
        flat, counts = self.ids.encode([cut(text) for text in texts])
        ends = np.cumsum(counts)
        return np.insert(flat, ends, self.model.eos_id()), counts + 1

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        ends = np.cumsum(counts)
        return [self.model.decode(flat[end - count:end].tolist()) for end, count in zip(ends, counts)]


_CODECS: dict[str, Codec] = {}


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", texts_at_once: int = 256) -> DataFrame:
    """(row key, doc_id, ids, decoded) of each row; ``path`` names the model, which every executor has."""
    keyed = with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encode(batches):
        codec = _CODECS.get(path) or _CODECS.setdefault(path, Codec(path))
        for batch in batches:
            for start in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(start, texts_at_once)
                flat, counts = codec.encode(part.column(2).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))),
                     pa.array(codec.decode(flat, counts), pa.string())], names=[ROW, "doc_id", "ids", "decoded"])

    return keyed.mapInArrow(encode, f"{ROW} long, doc_id long, ids array<int>, decoded string")


def op7_sentencepiece(spark, folder: str) -> DataFrame:
    import public_tokenizers

    out = encoded(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"))
