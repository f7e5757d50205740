"""What the operators of this folder share."""

from __future__ import annotations

import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Internal row key; rows that repeat a document's id stay apart by it.
ROW = "_row_key"
#: Low bits of a row key, which hold the place in the file.
ROW_BITS = 38

#: Paths of the files of tables that have been given keys.
_NUMBERED: weakref.WeakKeyDictionary[DataFrame, list[str]] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _files(docs: DataFrame) -> DataFrame:
    """(path, number) of a stored table's files, numbered in the order of their paths."""
    if docs not in _NUMBERED:
        inside = docs.metadataColumn("_metadata")
        held = docs.select(inside["file_path"].alias("path"), inside["row_index"].alias("at")).groupBy("path").agg(
            F.count(F.lit(1)).alias("rows"), F.max("at").alias("last")).collect()
        if any(row["rows"] > row["last"] + 1 for row in held):
            raise ValueError("a table that reads a file twice has no row keys")
        _NUMBERED[docs] = sorted(row["path"] for row in held)
    paths = _NUMBERED[docs]
    return docs.sparkSession.createDataFrame(pa.table({"path": pa.array(paths, pa.string()), "number": pa.array(range(len(paths)), pa.int64())}))


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with its row key as a further column."""
    taken, own = [*docs.columns, name], []
    for wanted in ("_path", "_at", "_number"):
        own.append(free_name(wanted, taken))
        taken.append(own[-1])
    path, at, number = own
    inside = docs.metadataColumn("_metadata")
    placed = docs.select("*", inside["file_path"].alias(path), inside["row_index"].alias(at))
    # a row per file, so it may be sent to all
    files = F.broadcast(_files(docs).withColumnsRenamed({"path": path, "number": number}))
    return placed.join(files, path).withColumn(name, F.shiftleft(number, ROW_BITS).bitwiseOR(F.col(at))).drop(*own)


def with_row_key(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of ``docs`` after a key that is unique per row.

    The key is the number of the row's file and its place in that file, so ``docs`` has to be a stored
    table (parquet): how a scan is split does not change the keys, nor does a lost task or executor.
    """
    key = free_name(ROW, docs.columns)
    return _keyed(docs, key).select(F.col(key).alias(ROW), *columns)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """A stored table joined with a table that has its row keys; the key itself is left out."""
    key = free_name(ROW, docs.columns)
    return _keyed(docs, key).join(rows.withColumnRenamed(ROW, key), key, how).drop(key)


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a stored table whose key is in ``rows``; columns as in ``docs``."""
    return join_by_row(docs, rows.select(ROW), "left_semi")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
