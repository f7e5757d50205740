"""Fact tables and results on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Names and columns of the fact tables.
FACT_TABLES = {
    "projects": "project string",
    "classes": "project string, package string, class_identifier string, modifier string,"
               " super_interfaces string, full_text string, header string, imports string, filepath string",
    "methods": "project string, package string, method_id bigint, method_identifier string,"
               " class_identifier string, full_text string, ord int",
    "class_variables": "project string, package string, class_identifier string,"
                       " variable_identifier string, variable_type string, ord int",
    "method_parameters": "project string, method_id bigint, parameter_type string, parameter_name string, ord int",
    "related_methods": "project string, source_id bigint, target_id bigint, ord int",
    "related_classes": "project string, method_id bigint, package string, class_identifier string, ord int",
}


def write_by(df: DataFrame, keys: list[str], path: str, mode: str, fmt: str = "parquet", **options) -> None:
    """Write partitioned by ``keys``.

    Rows are rebalanced by the keys first: a small partition becomes one file instead of
    one per task, and a partition that holds a third of all rows is split into many.
    """
    writer = df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).options(**options)
    writer.format(fmt).save(path)


def write_fact_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Replace the given projects in every fact table, leave the others alone.

    Only partitions that get a row are overwritten, so every table gets a row that is not
    listed for each project; a project that has lost its last edge then loses the old ones.
    """
    blank = tables["projects"].select("project").distinct().withColumn("listed", F.lit(False))
    for name, table in tables.items():
        table = table.withColumn("listed", F.lit(True)).unionByName(blank, allowMissingColumns=True)
        write_by(table, ["project"], f"{root}/{name}", "overwrite", partitionOverwriteMode="dynamic")


def read_fact_tables(spark: SparkSession, root: str, project: str | None = None) -> dict[str, DataFrame]:
    """Fact tables of all projects, or of one: a filter that prunes partitions."""
    tables = {}
    for name, schema in FACT_TABLES.items():
        table = spark.read.schema(f"{schema}, listed boolean").parquet(f"{root}/{name}").where("listed").drop("listed")
        tables[name] = table if project is None else table.where(F.col("project") == project)
    return tables


def write_artifacts(items: DataFrame, path: str, mode: str = "append", clustered: bool = False) -> None:
    """Prompt and generated text of each item, by project and package.

    A folder per project and package; with ``clustered``, for corpora of many packages, a folder per project, whose
    files hold runs of packages.  Rows are then dealt by range of (project, package, item), so a large package spans files of
    its own, small ones share one, and the least and greatest package that parquet keeps of each file let a reader of one
    package pass over all others.
    """
    if not clustered:
        return write_by(items, ["project", "package"], path, mode)
    keys = ["project", "package", *[key for key in ("method_id", "run") if key in items.columns]]
    items.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy("project").parquet(path)


def read_artifacts(spark: SparkSession, path: str, project: str | None = None, package: str | None = None) -> DataFrame:
    """Artifacts of all projects, of one, or of one package; both filters reach the scan."""
    found = spark.read.parquet(path)
    for key, value in (("project", project), ("package", package)):
        if value is not None:
            found = found.where(F.col(key) == value)
    return found


def route_by_outcome(items: DataFrame, path: str, mode: str = "append") -> None:
    """File each item under its outcome."""
    write_by(items, ["outcome"], path, mode)
