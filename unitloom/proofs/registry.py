"""Where the queries are listed."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

#: name -> (query, SQL or None)
PROOFS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def proof(sql: str | None = None, name: str | None = None):
    def register(query):
        PROOFS[name or query.__name__] = (query, sql)
        return query
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def template_sql(template: str, values: dict[str, str]) -> str:
    """A template as an SQL concatenation; ``values`` are SQL expressions."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(text_literal(literal))
        if name is not None:
            pieces.append(values[name])
    return "(" + " || ".join(pieces) + ")"


def tokens_sql(expression: str) -> str:
    return rf"len(regexp_extract_all({expression}, '\S+'))"
