"""The event log: an append-only CSV dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.functions.text import clean_info

# Column order, types and separator of the log.
EVENT_SCHEMA = "project_name string, method_id bigint, event string, result_code int, add_info string"
SEPARATOR = ";"


#: Place of an event among its item's events, a last column of logs whose events have one.
ORDER = "ord"


def write_events(events: DataFrame, path: str) -> None:
    """Append events; every file carries its own header line.

    Events with a column ``ord``, as :func:`unitloom.plans.rounds.to_events` gives them, keep it as the last one, so the
    order of an item's events does not hang on the order of lines or files.  One log holds events of one kind.
    """
    info = F.replace(clean_info(F.col("add_info")), F.lit("\\"), F.lit("\\\\"))
    order = [ORDER] if ORDER in events.columns else []
    rows = events.select("project_name", "method_id", "event", "result_code", info.alias("add_info"), *order)
    rows.write.mode("append").option("sep", SEPARATOR).option("header", True).option("escape", '"').csv(path)


def read_events(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Read a log written by :func:`write_events` or by a plain CSV writer.

    ``ordered`` also reads ``ord``, of a log that was written with it.

    The header line may be separated otherwise than the rows: the schema is enforced, so
    that line is skipped and not parsed.  Backslashes are stored doubled and an empty
    text comes back as null; both are undone here.
    """
    rows = (
        spark.read.schema(f"{EVENT_SCHEMA}, {ORDER} int" if ordered else EVENT_SCHEMA).option("sep", SEPARATOR).option("header", True)
        .option("enforceSchema", True).option("escape", '"').csv(path)
    )
    info = F.coalesce(F.replace(F.col("add_info"), F.lit("\\\\"), F.lit("\\")), F.lit(""))
    return rows.withColumn("add_info", info)
