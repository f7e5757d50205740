"""Folders listed, and files read and written, in tasks.

Spark's file reader leaves out names that start with ``_`` or ``.``, and lists for itself.  Here a folder
tree is a table: tasks list folders through the file system and pass on those they have not come to, so
the next round spreads them over more tasks.  What comes out is a table of paths and sizes, written once, which
can be filtered and joined before any content is read; contents are then read in tasks, as many
as their size asks for.
"""

from __future__ import annotations

import os
from collections import deque
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.session import cut_lineage

#: Folders a task lists before it passes on the rest, bytes a reading task is given, and bytes it holds at once.
FOLDERS_PER_TASK, BYTES_PER_TASK, BYTES_AT_ONCE = 500, 128_000_000, 8_000_000


def file_system(root: str):
    """File system and path of a folder: local paths, ``file:``, and the schemes that pyarrow opens."""
    from pyarrow import fs

    scheme, colon, rest = root.partition(":")
    if not colon or len(scheme) < 2 or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(root)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/").rstrip("/")
    authority, _, path = rest.removeprefix("//").partition("/")
    made, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return made, "/".join(part for part in (base.rstrip("/"), path.strip("/")) if part) or base


def list_files(spark: SparkSession, root: str, glob: str = "*", folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """(path, size) of every file below ``root`` whose name fits the shell pattern ``glob``; paths are relative to ``root``.

    A missing root is an error, whatever a name starts with it is listed, and links are followed.  An empty
    folder gives no rows.
    """
    from pyarrow import fs

    opened, base = file_system(root)
    if opened.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder {root}")

    def walk(batches):
        import pyarrow as pa

        opened, base = file_system(root)
        kinds = [pa.string(), pa.int64(), pa.bool_()]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names=["path", "size", "folder"])

        waiting, listed, found = deque(), 0, []
        for batch in batches:
            waiting.extend(batch.column(0).to_pylist())
        while waiting and listed < folders_per_task:
            folder = waiting.popleft()
            listed += 1
            for entry in opened.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)):
                path = f"{folder}/{entry.base_name}" if folder else entry.base_name
                if entry.type == fs.FileType.Directory:
                    waiting.append(path)
                elif entry.type == fs.FileType.File and fnmatchcase(entry.base_name, glob):
                    found.append((path, entry.size, False))
                if len(found) >= 50_000:
                    yield rows(found)
                    found = []
        found += [(folder, 0, True) for folder in waiting]
        if found:
            yield rows(found)

    folders, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = cut_lineage(folders.mapInArrow(walk, "path string, size long, folder boolean"), "listing")
        rounds.append(listed.where("NOT folder").select("path", "size"))
        left = listed.where("folder").select("path")
        tasks = min(left.count(), 4 * spark.sparkContext.defaultParallelism)
        if not tasks:
            break
        folders = left.repartition(tasks)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def read_files(paths: DataFrame, root: str, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """``paths``, a table with the columns path and size, with the content of each file as ``content``."""
    total = paths.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, -(-(total["size"] or 0) // bytes_per_task), min(total["n"], paths.sparkSession.sparkContext.defaultParallelism))
    kept = [column for column in paths.columns if column not in ("path", "size")]

    def read(batches):
        import pyarrow as pa

        opened, base = file_system(root)
        for batch in batches:
            names, start, contents, held = batch.column(0).to_pylist(), 0, [], 0
            for i, name in enumerate(names):
                with opened.open_input_stream(f"{base}/{name}") as stream:
                    contents.append(stream.read())
                held += len(contents[-1])
                if held >= BYTES_AT_ONCE or i + 1 == len(names):
                    part = batch.slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                    start, contents, held = i + 1, [], 0

    named = paths.select("path", *kept)
    read_all = named.repartition(tasks, "path").mapInArrow(read, named.schema.add("content", "binary"))
    return read_all.withColumn("content", F.col("content").cast("string"))


def write_files(files: DataFrame, root: str) -> int:
    """Write ``content`` of each row to ``path`` below ``root``; gives the number of files.

    A file is written beside its place and then moved there, so a task that runs again leaves whole files.  Of rows with one
    path, one stays.  A null path is an error, a null content an empty file.
    """
    def write(batches):
        import uuid

        import pyarrow as pa

        opened, base = file_system(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path is None:
                    raise ValueError("a file without a path")
                folder, _, name = f"{base}/{path}".rpartition("/")
                if folder not in made:
                    opened.create_dir(folder, recursive=True)
                    made.add(folder)
                beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with opened.open_output_stream(beside) as stream:
                    stream.write(content or b"")
                opened.move(beside, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    opened, base = file_system(root)
    opened.create_dir(base, recursive=True)
    counted = files.select("path", F.col("content").cast("binary")).mapInArrow(write, "n long")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
