"""The whole job: context, inference, clean-up, check and repair, outcome and events."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from unitloom.functions.templates import COMPILE_REPAIR, EXECUTION_REPAIR, INPUT_BUDGET, LEVELS, repair_prompt
from unitloom.functions.text import (
    first_class_name, last_block, package_from_path, rename_class, set_package, target_paths, unique_class_name,
)
from unitloom.functions.tokens import TokenCounter
from unitloom.operators.joins import cross_runs
from unitloom.plans.context import gather_context
from unitloom.plans.extract import class_names
from unitloom.plans import rounds
from unitloom.plans.rounds import (
    ANSWER_ERROR, ANSWER_FAILED, CLASS_NAME_ERROR, COMPILE_STAGE, EVENT, EXECUTION_STAGE, NO_CODE, OTHER, OTHER_ERROR,
    OVER_BUDGET, TIMEOUT, TIMEOUT_ERROR, infer, numbered, reading, start_items, thin_items,
)
from unitloom.session import Steps, Unnamed, shared_folder

# Fixed value: the message of an item whose path has no source root.
NO_SOURCE_ROOT = "'java' is not in list"


def with_units(answered: DataFrame) -> DataFrame:
    """Answers with their last block, the package of their path, and the block under that package line."""
    cleaned = answered.withColumn("block", last_block(F.col("answer"))).withColumn("package", package_from_path(F.col("filepath")))
    return cleaned.withColumn("unit", set_package(F.col("block"), F.col("package")))


def prepare_answer(answered: DataFrame, run_id: str, own_name: str | None = None) -> DataFrame:
    """Clean answers into units to check (I7): last block, package line, unique name.

    Needs prompt, answer, error, filepath, class_identifier, method_id.  Adds package,
    class_name and text, and ends items that have no usable answer, with their events.
    ``own_name`` is a column with the name of the unit's class; without it, a pattern finds it (F21).
    """
    cleaned = answered if own_name else with_units(answered)
    found = F.col(own_name) if own_name else first_class_name(F.col("unit"))
    new_name = unique_class_name(F.col("class_identifier"), F.col("method_id"), run_id)
    cleaned = cleaned.withColumn("class_name", new_name)
    cleaned = cleaned.withColumn("text", rename_class(F.col("unit"), F.col("class_name"), found))

    def events(*named: tuple[str, Column | str]) -> Column:
        made = [F.struct(F.lit(name).alias("event"), F.lit(1).alias("result_code"),
                         (F.lit(info) if isinstance(info, str) else info).alias("add_info")) for name, info in named]
        return F.array(*made).cast(f"array<{EVENT}>")

    cases = [
        (F.col("error") == TIMEOUT, OTHER, events((TIMEOUT_ERROR, ""))),
        (F.col("error").isNotNull(), OTHER, events((OTHER_ERROR, F.col("error")))),
        (F.col("prompt").isNull(), OVER_BUDGET, F.array().cast(f"array<{EVENT}>")),
        (F.col("block").isNull(), ANSWER_FAILED, events((NO_CODE, ""), (ANSWER_ERROR, ""))),
        (F.col("block") == "", ANSWER_FAILED, events((ANSWER_ERROR, ""))),
        (F.col("package").isNull(), OTHER, events((OTHER_ERROR, NO_SOURCE_ROOT))),
        (found.isNull(), ANSWER_FAILED, events((CLASS_NAME_ERROR, ""))),
    ]
    outcome, happened = None, None
    for condition, name, made in cases:
        outcome = F.when(condition, name) if outcome is None else outcome.when(condition, name)
        happened = F.when(condition, made) if happened is None else happened.when(condition, made)
    items = start_items(cleaned).withColumn("outcome", outcome)
    items = items.withColumn("events", F.coalesce(happened, F.col("events")))
    return items.drop("block", "unit", "answer", "error", *([own_name] if own_name else []))


def model_repair(make_model: Callable[[], Callable[[str], str]], template: str, budget: int = INPUT_BUDGET,
                 counter: TokenCounter | None = None, max_tries: int = 3, partitions: int | None = None,
                 ledger: str | None = None, apart: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A repair that asks the model, for :func:`repair_rounds` (F11); see :func:`infer` for ``ledger`` and ``apart``."""
    def apply(df: DataFrame) -> DataFrame:
        prompted = df.withColumn("_repair_prompt", repair_prompt(F.col("text"), F.col("output"), budget, template, counter))
        prompted = prompted.withColumn("_repair_prompt", F.nullif(F.col("_repair_prompt"), F.lit("")))
        asked = infer(prompted, "_repair_prompt", make_model, max_tries, "_repair_answer", "_repair_error", partitions, ledger=ledger, apart=apart)
        asked = asked.withColumn("_block", last_block(F.col("_repair_answer")))
        block = F.col("_block")
        lost = F.col("_repair_answer").isNotNull() & block.isNull()
        note = F.struct(F.lit(NO_CODE).alias("event"), F.lit(1).alias("result_code"), F.lit("").alias("add_info"))
        return asked.withColumns({
            "repaired": F.when(block != "", set_package(block, F.col("package"))),
            "repair_events": F.when(lost, F.array(note)).cast(f"array<{EVENT}>"),
        }).drop("_repair_prompt", "_repair_answer", "_repair_error", "_block")
    return reading(apply, "package", *(apart or []))


def generate_units(tables: dict[str, DataFrame], make_model: Callable[[], Callable[[str], str]],
                   compile_check: Callable[[DataFrame], DataFrame], run_check: Callable[[DataFrame], DataFrame],
                   run_id: str, runs: int = 1, only: Column | None = None, compile_rounds: int = 1,
                   run_rounds: int = 1, budget: int = INPUT_BUDGET, levels: tuple[str, ...] = LEVELS,
                   counter: TokenCounter | None = None, max_tries: int = 3,
                   partitions: int | None = None, folder: str | None = None, make_parser: Callable | None = None) -> DataFrame:
    """Generate, check and repair a unit for every method, or those ``only`` picks.

    One row per method and run, with its prompt, text, outcome, number of repairs and
    events.  An item that ends early or fails stays in the result under its outcome.

    Prompts are written once per method, asked once per run, and meet their items again in the last join; rounds
    carry texts.  With ``folder``, which all executors reach, steps and answers are kept there under the run id: a job
    that starts again with the same folder, run id and inputs goes on after the last finished step, and asks
    the model for nothing that was answered.

    With ``make_parser``, the class that an answer holds is found by its syntax tree, otherwise by a pattern.
    """
    spark = tables["methods"].sparkSession
    home = f"{(folder or shared_folder(spark)).rstrip('/')}/run-{run_id if folder else uuid.uuid4().hex}"
    kept, ledger = (Steps(spark, home) if folder else Unnamed()), f"{home}/answers"
    context = kept.keep(lambda: gather_context(tables, budget, levels, counter, only=only), "prompts")

    def answered() -> DataFrame:
        asked = infer(cross_runs(context, runs), "prompt", make_model, max_tries, partitions=partitions, ledger=ledger, apart=["run"])
        own_name = None
        if make_parser is not None:
            own_name = "_own_name"
            units = kept.keep(lambda: with_units(asked).withColumn("_unit", F.monotonically_increasing_id()), "units")
            names = class_names(units.where("unit IS NOT NULL"), make_parser, "_unit", "unit").withColumnRenamed("class_name", own_name)
            asked = units.join(names, "_unit", "left").drop("_unit")
        prepared = prepare_answer(asked, run_id, own_name).withColumn("paths", target_paths(F.col("filepath"), F.col("project")))
        return numbered(prepared.drop("prompt"))

    items = kept.keep(answered, "items")

    def repair(template: str) -> Callable[[DataFrame], DataFrame]:
        return model_repair(make_model, template, budget, counter, max_tries, partitions, ledger, ["run"])

    repairs = repair(COMPILE_REPAIR), repair(EXECUTION_REPAIR)
    thin = thin_items(items, compile_check, run_check, *repairs)
    compiled = rounds.run_rounds(thin, compile_check, repairs[0], compile_rounds, COMPILE_STAGE, None, partitions, kept)
    # repairs are counted per stage
    fresh = kept.keep(compiled.rows, "compiled").withColumn("compile_repairs", F.col("repairs")).withColumn("repairs", F.lit(0))
    ran = rounds.run_rounds(fresh, run_check, repairs[1], run_rounds, EXECUTION_STAGE, compile_check, partitions, kept)
    out = rounds.with_outcome(items, ran.rows(), [compiled, ran], ["compile_repairs"])
    return out.join(context.select("project", "method_id", "prompt"), ["project", "method_id"])
