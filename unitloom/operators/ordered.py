"""Ordered aggregates and row positions, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from unitloom.session import cut_lineage


def last_wins(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "value") -> DataFrame:
    """Value of the last entry per key (A5); combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))


def first_wins(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "value") -> DataFrame:
    """Value of the first entry per key (A7); combined before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(name))


def last_wins_map(df: DataFrame, keys: list[str], name: str, value: str, order: list[str], result: str) -> DataFrame:
    """Map name -> value per key, last entry per name (A5)."""
    entries = last_wins(df, [*keys, name], value, order, "_value")
    pairs = F.collect_list(F.struct(F.col(name), F.col("_value")))
    return entries.groupBy(*keys).agg(F.map_from_entries(pairs).alias(result))


def ordered_join(df: DataFrame, keys: list[str], text: Column, order: list[str], separator: str = "\n",
                 name: str = "text") -> DataFrame:
    """Join a group's lines in order (A3).

    For groups cut from one source text, which are no longer than that text; see
    :func:`ordered_lines` for groups without such a bound.
    """
    lines = F.sort_array(F.collect_list(F.struct(*order, text.alias("_text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda row: row["_text"]), separator).alias(name))


def _same(left: list[str], right: list[str]) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]


def positions(df: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Dense position of each row in its group, from 1, by a total order.

    A window per group would put a whole group in one task.  Here the keys, and nothing else, are range
    partitioned by (group, order), so a large group spans many slices.  Each slice is numbered by
    itself; its rows per group are counted, and prefix sums over the counts, a row per group and slice, say where it starts.
    The slices are written once, since a range partitioning computed a second time may cut elsewhere.

    Further columns never enter the range partitioning: they meet their numbers in one join by the whole
    key, which no hot group can skew.  With further columns, the key has to be unique.
    """
    keys = [*group, *order]
    kept = [column for column in df.columns if column not in keys]
    sliced = (
        df.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    sliced = cut_lineage(sliced, "positions")
    spans = sliced.groupBy(*group, "_slice").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count")
    )
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(
        *[F.col(key).alias(f"_g_{key}") for key in group], F.col("_slice").alias("_g_slice"),
        (F.coalesce(F.sum("_count").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    match = [*_same(group, [f"_g_{key}" for key in group]), F.col("_slice") == F.col("_g_slice")]
    numbers = sliced.join(offsets, match).select(*keys, (F.col("_row") + F.col("_shift")).alias(name))
    if not kept:
        return numbers.select(*df.columns, name)
    numbers = numbers.withColumnsRenamed({key: f"_k_{key}" for key in keys})
    return df.join(numbers, _same(keys, [f"_k_{key}" for key in keys])).select(*df.columns, name)


def assign_ids(df: DataFrame, group: list[str], order: list[str], name: str = "id") -> DataFrame:
    """Dense ids from 1 within a group, in the group's order."""
    return positions(df, group, order, name)


def ordered_lines(df: DataFrame, keys: list[str], text: Column, order: list[str], name: str = "text") -> DataFrame:
    """A group's lines as rows (keys, position, text), for groups of any size (A3, A4).

    The lines of a group are its text: whoever reads them in the order of ``position`` has it, and no row
    or task holds a group.  See :func:`ordered_join` where a group is known to fit a row.
    """
    lines = positions(df.select(*keys, *order, text.alias("_text")), keys, order)
    return lines.select(*keys, "position", F.col("_text").alias(name))


def ordered_parts(df: DataFrame, keys: list[str], text: Column, order: list[str], separator: str = "\n",
                  name: str = "text", *, rows_per_part: int) -> DataFrame:
    """Join a group's lines in order, in parts of ``rows_per_part`` lines as the caller asks (A3, A4).

    Gives (keys, part, text) with parts from 0, every one but a group's last of exactly that many lines.
    """
    lines = ordered_lines(df, keys, text, order, "_text")
    part = ((F.col("position") - 1) / rows_per_part).cast("bigint").alias("part")
    gathered = F.sort_array(F.collect_list(F.struct("position", "_text")))
    joined = F.array_join(F.transform(gathered, lambda row: row["_text"]), separator)
    return lines.groupBy(*keys, part).agg(joined.alias(name))


def attach_previous(df: DataFrame, group: list[str], order: list[str], text: str, take_if: Column,
                    separator: str = "\n", rows_per_slice: int | None = None) -> DataFrame:
    """Put the row just before in front of a row's text, where that row meets ``take_if``.

    Rows are numbered by their keys alone.  A row that is taken is named to the next number of its group,
    so only keys tell who takes what; then the taken texts, and no others, move to the rows that take
    them.  ``rows_per_slice`` is no longer needed and not read.
    """
    keys = [*group, *order]
    flagged = df.select(*keys, F.coalesce(take_if, F.lit(False)).alias("_take"))
    numbers = cut_lineage(positions(flagged, group, order, "_position"), "numbers")
    taken = numbers.where("_take").select(
        *[F.col(key).alias(f"_g_{key}") for key in group], *[F.col(key).alias(f"_b_{key}") for key in order], (F.col("_position") + 1).alias("_next"))
    wanted = cut_lineage(numbers.join(taken, [*_same(group, [f"_g_{key}" for key in group]), F.col("_position") == F.col("_next")]).select(
        *[F.col(key).alias(f"_k_{key}") for key in keys], *[f"_b_{key}" for key in order]), "wanted")
    leads = df.select(*keys, F.col(text).alias("_lead")).join(
        wanted, _same(keys, [*[f"_k_{key}" for key in group], *[f"_b_{key}" for key in order]]))
    leads = leads.select("_lead", *[F.col(f"_k_{key}") for key in keys])
    joined = F.coalesce(F.concat("_lead", F.lit(separator), F.col(text)), F.col(text))
    out = df.join(leads, _same(keys, [f"_k_{key}" for key in keys]), "left").withColumn("_joined", joined)
    return out.select(*[F.col("_joined").alias(text) if column == text else F.col(column) for column in df.columns])
