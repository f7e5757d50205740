"""Source files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from unitloom.sources.listing import list_files, read_files

# Which files count as sources.
SOURCE_SUFFIX = ".java"
TEST_NAME_MARKER = "Test"
TEST_FOLDER = "test"

#: An error names so many groups, and says how many more there are.
NAMED = 20


def path_filter(path: Column, suffix: str = SOURCE_SUFFIX, name_marker: str = TEST_NAME_MARKER,
                dir_word: str = TEST_FOLDER) -> Column:
    """Name ends with ``suffix`` and lacks ``name_marker``; no folder equals ``dir_word``."""
    parts = F.split(path, "/", -1)
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return name.endswith(suffix) & ~name.contains(name_marker) & ~F.array_contains(folders, dir_word)


def scan_sources(spark: SparkSession, root: str, glob: str = "*" + SOURCE_SUFFIX) -> DataFrame:
    """Every file below ``root`` as (path, content), path relative to root, names with `_` or `.` in front too.

    Folders are listed and files read in tasks, see :mod:`unitloom.sources.listing`.  A missing root is an error (S3).
    """
    return read_files(list_files(spark, root, glob), root)


def with_project(files: DataFrame) -> DataFrame:
    """First folder of the path is the project; files beside the projects are dropped."""
    project = F.regexp_extract("path", r"^([^/]+)/", 1)
    return files.withColumn("project", project).where(F.col("project") != "")


def count_by_group(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per group (A2)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def missing_groups(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Groups that should have rows and have none (S3); both sides are one row per group."""
    return expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def require_groups(expected: DataFrame, found: DataFrame, key: str) -> None:
    """Fail if there is no group at all, or one of them has no rows (S3)."""
    if expected.select(key).isEmpty():
        raise ValueError(f"no {key} found")
    missing = missing_groups(expected, found, key)
    lost = [row[0] for row in missing.limit(NAMED + 1).collect()]
    if lost:
        more = f" and {missing.count() - NAMED} more" if len(lost) > NAMED else ""
        raise ValueError(f"no sources left in {key}: {', '.join(map(str, lost[:NAMED]))}{more}")


def project_sources(spark: SparkSession, root: str, glob: str = "*" + SOURCE_SUFFIX) -> DataFrame:
    """Sources of all projects below ``root`` as (project, path, content).

    Paths are chosen first, so no other file is read.
    """
    paths = with_project(list_files(spark, root, glob)).where(path_filter(F.col("path")))
    return read_files(paths, root).select("path", "content", "project")
