"""Operators over a node table: the syntax trees of all files at once.

``node_id`` numbers a file's nodes in preorder from 0 and ``last_desc_id`` is the last
node below, so "anywhere below" is a range of ids.  All nodes of a file come from one
text, which fits a row, so a window over one file is bounded by that row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from unitloom.functions.text import node_text

# Columns of the node table.
NODE_SCHEMA = (
    "file_id bigint, node_id int, last_desc_id int, parent_id int, ord int, type string,"
    " is_named boolean, field_name string, start_byte int, end_byte int"
)
NODE_COLUMNS = [field.split()[0] for field in NODE_SCHEMA.split(", ")]

#: Columns that grow, or nearly so, along a file.
RISING = ("node_id", "last_desc_id", "start_byte", "end_byte")

#: Ids per bucket of the range join in :func:`descendants`.
IDS_PER_BUCKET = 256


def nodes_from(sources: DataFrame, make_parser: Callable[[], Callable[[str], Iterator[tuple]]],
               key: str = "file_id", content: str = "content", rows_per_batch: int = 50_000,
               partitions: int | None = None) -> DataFrame:
    """Node table of source texts; the parser is the user's.

    ``make_parser`` builds, once per task, a function from a text to its nodes as tuples
    in the order of the node table without its ``file_id``.  ``partitions`` spreads the
    texts first, where they come in few large splits.  Many facts are read from a node
    table, so write it (:func:`unitloom.session.cut_lineage`, or a table of its own)
    before use: otherwise each of them parses again.
    """
    names = NODE_COLUMNS

    def parse(batches):
        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(),
                 pa.bool_(), pa.string(), pa.int32(), pa.int32()]
        parser = make_parser()
        rows, counts = [], []

        def batch_of():
            ids = np.repeat([0 if file_id is None else file_id for file_id, _ in counts], [count for _, count in counts])
            lost = np.repeat([file_id is None for file_id, _ in counts], [count for _, count in counts])
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:])]
            return pa.RecordBatch.from_arrays([pa.array(ids, kinds[0], mask=lost), *columns], names=names)

        for batch in batches:
            for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = len(rows)
                rows.extend(parser(text))
                counts.append((file_id, len(rows) - before))
                if len(rows) >= rows_per_batch:
                    yield batch_of()
                    rows, counts = [], []
        if rows:
            yield batch_of()

    texts = sources.select(F.col(key).cast("bigint"), F.col(content))
    if partitions is not None:
        texts = texts.repartition(partitions)
    return texts.mapInArrow(parse, NODE_SCHEMA)


def children(parents: DataFrame, nodes: DataFrame, type: str | None = None, field: str | None = None,
             parent_columns: dict[str, str] | None = None) -> DataFrame:
    """Child nodes of given nodes, of a type (J13) or at a field.

    ``parent_columns`` names columns of the parent to keep and what to call them.
    """
    kept = parent_columns or {}
    side = parents.select(F.col("file_id").alias("_file"), F.col("node_id").alias("_parent"),
                          *[F.col(column).alias(alias) for column, alias in kept.items()])
    wanted = nodes
    if type is not None:
        wanted = wanted.where(F.col("type") == type)
    if field is not None:
        wanted = wanted.where(F.col("field_name") == field)
    match = (F.col("file_id") == F.col("_file")) & (F.col("parent_id") == F.col("_parent"))
    return wanted.join(side, match).drop("_file", "_parent")


def descendants(ancestors: DataFrame, nodes: DataFrame, ids_per_bucket: int = IDS_PER_BUCKET) -> DataFrame:
    """Pairs of an ancestor and a node anywhere below it, itself included.

    Gives the columns of ``nodes`` and ``ancestor_id``.  A range of ids is cut into
    buckets and joined by (file, bucket): the join is an equi-join, and what the range
    filter has to discard is at most a bucket's worth of ids at either end of a range.
    """
    spans = ancestors.select(
        F.col("file_id").alias("_file"), F.col("node_id").alias("ancestor_id"), F.col("last_desc_id").alias("_last"),
        F.explode(F.sequence(F.floor(F.col("node_id") / ids_per_bucket), F.floor(F.col("last_desc_id") / ids_per_bucket)))
        .alias("_span"),
    )
    placed = nodes.withColumn("_bucket", F.floor(F.col("node_id") / ids_per_bucket))
    match = (
        (F.col("file_id") == F.col("_file")) & (F.col("_bucket") == F.col("_span"))
        & F.col("node_id").between(F.col("ancestor_id"), F.col("_last"))
    )
    return placed.join(spans, match).drop("_file", "_last", "_bucket", "_span")


def node_struct(*extra: str) -> Column:
    return F.struct("node_id", "last_desc_id", "start_byte", "end_byte", *extra)


def look_back(nodes: DataFrame, **wanted: tuple[Column, Column]) -> DataFrame:
    """Latest value at or before each node in preorder (J12), one window for all.

    ``wanted`` maps a new column to (condition, value).
    """
    preorder = Window.partitionBy("file_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.select("*", *[
        F.last(F.when(condition, value), ignorenulls=True).over(preorder).alias(name)
        for name, (condition, value) in wanted.items()
    ])


def enclosing(nodes: DataFrame, **owners: tuple[Column, Column]) -> DataFrame:
    """The owner node around each node, for owners that do not nest.

    That is the latest owner in preorder, if its range reaches the node: no join.  The
    values must be structs with a ``last_desc_id``.
    """
    found = look_back(nodes, **owners)
    return found.withColumns({
        name: F.when(F.col(name)["last_desc_id"] >= F.col("node_id"), F.col(name)) for name in owners
    })


def first_below(nodes: DataFrame, **wanted: tuple[Column, Column]) -> DataFrame:
    """First descendant that meets a condition, the node itself included.

    In preorder this is simply the next such node, if it is still in the node's range: a
    window over the file, no join.  The values must be structs with a ``node_id``.
    """
    ahead = Window.partitionBy("file_id").orderBy(F.col("node_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = nodes.select("*", *[
        F.last(F.when(condition, value), ignorenulls=True).over(ahead).alias(name)
        for name, (condition, value) in wanted.items()
    ])
    return found.withColumns({
        name: F.when(F.col(name)["node_id"] <= F.col("last_desc_id"), F.col(name)) for name in wanted
    })


def with_text(rows: DataFrame, sources: DataFrame, carry: list[str] | None = None, **spans: Column | tuple[Column, Column]) -> DataFrame:
    """Cut texts of nodes from their file's content.

    ``spans`` maps a new column to a struct with start_byte and end_byte, or to a pair of
    columns.  ``sources`` is (file_id, content_bytes).  Texts are cut right at the join,
    so the content itself is not carried on; a null span gives a null text.  ``carry`` names
    further columns of the sources to keep.
    """
    kept = carry or []
    joined = rows.join(sources.select("file_id", "content_bytes", *kept), "file_id")
    cut = {}
    for name, span in spans.items():
        start, end = span if isinstance(span, tuple) else (span["start_byte"], span["end_byte"])
        cut[name] = node_text(F.col("content_bytes"), start, end)
    return joined.select(*rows.columns, *kept, *[text.alias(name) for name, text in cut.items()])
