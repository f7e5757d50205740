"""Session settings and lineage cutting shared by every plan."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, types as T

#: Runtime settings every job of this library relies on.  The skew-join rule is the
#: one that splits a hot join key, so it is forced even where it adds a shuffle.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: How plans over facts are cut into tasks.  Shuffled rows take some ten times their compressed bytes where they are sorted, so
#: Spark's 64 MB of shuffle a task are much of a task's memory on larger tables.  A table's files say little of its rows
#: either: a few MB can hold millions, which the driver would have to hold to broadcast them.  So only tables of very small files are
#: broadcast as planned, others by the size of their rows, once these are shuffled.
TASK_SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
}


#: Shuffles of a query are removed when it ends, instead of when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Task settings as they were before plans over facts.
_BEFORE: dict[str, str | None] = {}

#: Folders of the steps written by this process, oldest first.
_STEPS: list[str] = []


def tune(spark: SparkSession, small_tasks: bool = False) -> SparkSession:
    """Settings of this library, with ``small_tasks`` those of plans over facts too; without it, these are put back as they were.

    A value that was set by others since stands for what was there before.
    """
    for key, value in ADAPTIVE_SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in TASK_SETTINGS.items():
        now = spark.conf.get(key, None)
        if small_tasks:
            if key not in _BEFORE or now != value:
                _BEFORE[key] = now
            spark.conf.set(key, value)
        elif key in _BEFORE:
            before = _BEFORE.pop(key)
            if now == value:
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, as the cluster names it.

    Only a local master may fall back to a temporary folder; a cluster without the
    setting is an error, since a machine-local folder would lose rows with its host.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="unitloom-"))
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind: a step that is stored has no more use for them."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, label: str = "step", rising: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A written table is computed exactly once, which matters when a step calls a model,
    and survives the loss of any executor.  Numbers of the columns ``rising`` are stored as differences from row to row.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    stored = {"parquet.writer.version": "v2", **{f"parquet.enable.dictionary#{column}": "false" for column in rising}} if rising else {}
    with shuffles_dropped(spark):
        df.write.options(compression="zstd", **stored).parquet(path)
    _STEPS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def steps_written() -> list[str]:
    """Folders of the steps this process has written and not dropped."""
    return list(_STEPS)


def drop_steps(spark: SparkSession, paths: list[str]) -> None:
    """Remove steps whose results are stored elsewhere; a table that still reads them is lost."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        _STEPS.remove(path)


class Steps:
    """Steps under names in a folder of a job's own, with a manifest of those that are finished.

    A job that starts again with the same folder reads finished steps and goes on from there; a step that was
    being written is written anew.  A step's name says what it is, so the folder must belong to one job and
    one set of inputs: name it by a run id.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        self.finished: dict[str, T.StructType] = {}
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            for row in spark.read.schema("step string, columns string").json(f"{self.folder}/manifest").collect():
                self.finished[row["step"]] = T.StructType.fromJson(json.loads(row["columns"]))

    def keep(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        """What ``make`` gives, written under ``name`` and read back; if that step is finished, only read, and ``make`` is not called."""
        path = f"{self.folder}/{name}"
        if name not in self.finished:
            df = make()
            df.write.mode("overwrite").parquet(path)
            note = self.spark.createDataFrame([(name, df.schema.json())], "step string, columns string")
            note.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
            self.finished[name] = df.schema
        return self.spark.read.schema(self.finished[name]).parquet(path)


class Unnamed:
    """Steps that are not found again: each is written under a new name to the shared folder."""

    def keep(self, make: Callable[[], DataFrame], name: str) -> DataFrame:
        return cut_lineage(make(), name)
