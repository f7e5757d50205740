"""A training corpus from raw documents: rejected, deduplicated, sanitised and packed.

Each stage takes (spark, docs, folder), where ``docs`` is the stored result of the stage before and
``folder`` holds the tables, and returns a DataFrame.  All stages but the last return the columns of
``docs``.  A stage that is called has its predecessor's result stored already, so it first removes the
steps that the predecessor left in the shared folder.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.llm import block_naming, jaccard, packing, sanitise, toxicity
from unitloom.llm.common import ROW, keep_rows, table
from unitloom.session import drop_steps, shared_folder, shuffles_dropped, steps_written, tune

#: Steps of the stage called last.
_LEFT: list[str] = []


def _tidy(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        drop_steps(spark, [path for path in _LEFT if path in steps_written()])
        before = set(steps_written())
        out = stage(spark, docs, folder)
        _LEFT[:] = [path for path in steps_written() if path not in before]
        return out
    return run_stage


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier trained on the labels does not reject."""
    return toxicity.drop_toxic(docs, table(spark, folder, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest id."""
    return block_naming.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the row with the smallest id.

    Documents without words are linked with nothing and stay.  Of linked rows that repeat the smallest id, the
    first stays; rows that no link connects are documents of their own, whatever their ids.
    """
    rows = jaccard.jaccard_components(docs, words=5, similar=80)
    first = rows.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct("doc_id", ROW)).alias("first"))
    return keep_rows(docs, first.select(F.col(f"first.{ROW}").alias(ROW)).unionByName(rows.where("n_shingles = 0").select(ROW)))


def sanitise_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without personal data and the terms that disclose it; n_chars follows the text."""
    clean = sanitise.sanitised(docs)
    if "n_chars" not in docs.columns:
        return clean
    chars = F.coalesce(F.length("text").cast("long"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", chars).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop(ROW)


STAGES = [
    (stage.__name__, _tidy(stage)) for stage in (reject_toxic, drop_exact_copies, drop_near_copies, sanitise_texts, pack)
]

#: A trained classifier, a learned disclosure list and a heuristic packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages, each written to the shared folder and read again."""
    tune(spark)
    docs, place = table(spark, folder, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, folder)
        with shuffles_dropped(spark):
            out.write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
