"""Batch inference, validation, and bounded rounds of check and repair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from unitloom.functions.text import clean_info, event_name
from unitloom.plans.child import LimitedCalls
from unitloom.plans.ledger import ask_once
from unitloom.session import Steps, Unnamed

RESULT = "struct<code:int,output:string>"
EVENT = "struct<event:string,result_code:int,add_info:string>"

# Event names, outcome names and result codes.
NO_CODE = "No Source Code in Answer Error"
ANSWER_ERROR = "Answer Extraction Error"
CLASS_NAME_ERROR = "Class Name Extraction Error"
OTHER_ERROR = "Other Error"
TIMEOUT_ERROR = "Timeout Error"
TIMEOUT = "Timeout"
PASSED, COMPILE_ERROR, EXECUTION_ERROR = "passed", "compile_error", "execution_error"

#: Outcomes of items that end before a check decides.
OVER_BUDGET, ANSWER_FAILED, REPAIR_FAILED, OTHER = "over_budget", "answer_error", "repair_error", "other_error"


@dataclass(frozen=True)
class Stage:
    """Event names of one check-and-repair stage; ``{n}`` is the round."""

    name: str
    passed: str
    failed: str
    no_repair: str
    gate_failed: str = ""
    outcome_failed: str = ""
    outcome_passed: str | None = None


#: Seconds after which a task passes on what it has.
PASSED_ON_AFTER = 1.0

#: Number of an item within one job.
ITEM = "_item"

#: What the log says of a check that gave no code.
NO_RESULT = "no result"

# The event names of both stages (one word twice is meant so).
COMPILE_STAGE = Stage(
    name="compile",
    passed="Compilation Successful Round {n}",
    failed="Compilation Error Round {n}",
    no_repair="Compilation Repair Prompt Construction Error Round {n}",
    outcome_failed=COMPILE_ERROR,
)
EXECUTION_STAGE = Stage(
    name="run",
    passed="Execution Successful after {n} repairs",
    failed="Execution Error after after {n} repairs",
    no_repair="Execution Repair Prompt Construction Error Round {n}",
    gate_failed="Compilation Error during Execution Repair Round {n}",
    outcome_failed=EXECUTION_ERROR,
    outcome_passed=PASSED,
)


class Caller:
    """Calls of a user's function that try again, and say what went wrong (U4).

    ``at_once`` is None for a function of one value, or the most values a function of lists gets; values of a list that
    fails are tried one by one.  With ``seconds``, calls run in a child process and are ended at that limit.
    """

    def __init__(self, make_fn: Callable[[], Callable], max_tries: int = 1, fallback: Callable | None = None,
                 seconds: float | None = None, at_once: int | None = None):
        self.fn = make_fn() if seconds is None else LimitedCalls(make_fn, seconds)
        self.max_tries, self.fallback, self.at_once = max_tries, fallback, at_once

    def one(self, value):
        message = None
        for _ in range(self.max_tries):
            try:
                return (self.fn(value) if self.at_once is None else self.fn([value])[0]), None
            except Exception as raised:
                instead = self.fallback(raised) if self.fallback else None
                if instead is not None:
                    return instead, None
                message = TIMEOUT if isinstance(raised, TimeoutError) else str(raised) or type(raised).__name__
        return None, message

    def __call__(self, values: list) -> list[tuple]:
        if self.at_once is not None and len(values) > 1:
            try:
                found = list(self.fn(values))
                if len(found) == len(values):
                    return [(value, None) for value in found]
            except Exception:  # which value it was shows below
                pass
        return [self.one(value) for value in values]

    def close(self) -> None:
        if isinstance(self.fn, LimitedCalls):
            self.fn.close()


def per_row(df: DataFrame, columns: str | list[str], make_fn: Callable[[], Callable], kind: T.DataType | str, name: str,
            max_tries: int = 1, error: str | None = "error", fallback: Callable | None = None,
            time_limit: float | None = None, at_once: int | None = None) -> DataFrame:
    """Append a user function's value for each row, over Arrow batches.

    The function is built once per task.  It sees the value of ``columns``, or a dict of
    values where that is a list.  Other columns pass through untouched, and a row whose
    (first) column is null is not shown to the function.  A row whose function raises is tried again,
    at most ``max_tries`` times, and then carries the message in ``error`` (U4), which is
    ``Timeout`` for a TimeoutError; ``fallback`` turns an exception into a value instead where it returns one.

    With ``time_limit`` the function is built and called in a child process of the worker.  A call that takes longer
    is ended with that process, whatever it does, and counts as a TimeoutError; the next call gets a new process.
    With ``at_once``, the function gets a list of so many rows at most and returns a list; rows of a list that fails
    are tried one by one.  Results are passed on every second, so a lost task has lost few answers in memory.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    value_type = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    arrow_type = to_arrow_type(value_type)
    single = isinstance(columns, str)
    shown = [columns] if single else list(columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, value_type)])
    if error:
        schema = schema.add(error, "string")

    def run(batches):
        import time

        import pyarrow as pa

        call = Caller(make_fn, max_tries, fallback, time_limit, at_once)

        def passed_on(part, results):
            arrays = [*part.columns, pa.array([value for value, _ in results], arrow_type)]
            names = [*part.schema.names, name]
            if error:
                arrays.append(pa.array([message for _, message in results], pa.string()))
                names.append(error)
            return pa.RecordBatch.from_arrays(arrays, names=names)

        try:
            for batch in batches:
                rows, results, start, since = batch.select(shown).to_pylist(), [], 0, time.monotonic()
                for first in range(0, len(rows), at_once or 1):
                    part = rows[first:first + (at_once or 1)]
                    answered = iter(call([row[shown[0]] if single else row for row in part if row[shown[0]] is not None]))
                    results += [(None, None) if row[shown[0]] is None else next(answered) for row in part]
                    if time.monotonic() - since >= PASSED_ON_AFTER:
                        yield passed_on(batch.slice(start, len(results)), results)
                        start, results, since = start + len(results), [], time.monotonic()
                if results:
                    yield passed_on(batch.slice(start, len(results)), results)
        finally:
            call.close()

    return df.mapInArrow(run, schema)


def infer(df: DataFrame, prompt: str, make_fn: Callable[[], Callable[[str], str]], max_tries: int = 3,
          answer: str = "answer", error: str = "error", partitions: int | None = None,
          time_limit: float | None = None, at_once: int | None = None, ledger: str | None = None,
          apart: list[str] | None = None) -> DataFrame:
    """Answer of a model for each prompt.

    ``partitions`` spreads the prompts evenly first, for calls that take long.  With
    ``at_once`` the model gets lists of prompts.  ``time_limit`` bounds each call in seconds.

    With ``ledger``, a folder that all executors reach, equal prompts are asked once, unless they differ in the
    columns ``apart``; answers are filed there as they come, and what is on file is not asked again, by a
    task that is run again or by another job (see :mod:`unitloom.plans.ledger`).
    """
    if ledger is not None:
        def caller():
            return Caller(make_fn, max_tries, seconds=time_limit, at_once=at_once)
        return ask_once(df, prompt, ledger, caller, answer, error, apart, partitions, at_once or 1)
    spread = df if partitions is None else df.repartition(partitions)
    return per_row(spread, prompt, make_fn, "string", answer, max_tries, error, time_limit=time_limit, at_once=at_once)


def column_check(check: Callable[[Column], Column], text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A check written as a column expression: text -> struct(code, output)."""
    def apply(df: DataFrame) -> DataFrame:
        return df.withColumn("checked", F.when(F.col(text).isNotNull(), check(F.col(text)).cast(RESULT)))
    return reading(apply, text)


def reading(fn: Callable, *columns: str) -> Callable:
    """Tell the rounds which columns a check or repair reads; one that does not say gets all."""
    fn.reads = columns
    return fn


def row_check(make_fn: Callable[[], Callable], columns: str | list[str] = "text",
              time_limit: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """A check written in Python: text, or a dict of columns, -> (code, output).

    A TimeoutError of the function, or a call of over ``time_limit`` seconds, is the result
    (1, 'Timeout') (F17); any other
    exception makes the row end as an error, and no other row with it (U4).
    """
    timed_out = {"code": 1, "output": TIMEOUT}

    def late(raised):
        return timed_out if isinstance(raised, TimeoutError) else None

    def make():
        fn = make_fn()

        def run(value):
            code, output = fn(value)
            return {"code": code, "output": output}
        return run

    def apply(df: DataFrame) -> DataFrame:
        return per_row(df, columns, make, RESULT, "checked", error="check_error", fallback=late, time_limit=time_limit)
    return reading(apply, *([columns] if isinstance(columns, str) else columns))


def _event(name: Column, code: int, info: Column | None = None) -> Column:
    return F.struct(
        name.alias("event"), F.lit(code).alias("result_code"),
        clean_info(info if info is not None else F.lit("")).alias("add_info"),
    ).cast(EVENT)


def start_items(items: DataFrame) -> DataFrame:
    """Items with the columns the rounds keep: repairs, outcome and events."""
    return items.withColumns({
        "repairs": F.lit(0), "outcome": F.lit(None).cast("string"),
        "events": F.array().cast(f"array<{EVENT}>"),
    })


def repair_rounds(items: DataFrame, check: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame],
                  rounds: int, stage: Stage = COMPILE_STAGE, gate: Callable[[DataFrame], DataFrame] | None = None,
                  partitions: int | None = None, steps: Steps | None = None) -> DataFrame:
    """Check items, repair what failed, check again; at most ``rounds`` repairs.

    ``items`` come from :func:`start_items` and have a ``text``; items that already have
    an outcome pass through.  ``check`` adds ``checked``, a struct (code, output), and may
    add ``check_error``.  ``repair`` sees the columns ``text`` and ``output`` and adds
    ``repaired``, null or '' where there is none, and may add ``repair_events``.  With a
    ``gate``, a repaired text must pass it before it is checked, or the item stops with
    the result it had.  ``partitions`` spreads the items before checks that take long (I5).

    The items are numbered and written once.  Rounds carry an item's number, its text and the columns that
    check, gate and repair read (see :func:`reading`); the rest, and events, meet the outcome in
    one join at the end.  Each round handles only what is still pending and is written once, so a plan never
    asks a model twice for one answer.  With ``steps``, finished rounds are kept under their names, and a job that
    starts again goes on after them.  An item whose check gives no code, or that has no text, ends as an error.  Every
    item ends exactly once.
    """
    kept = steps or Unnamed()
    given = items
    items = kept.keep(lambda: numbered(given), f"{stage.name}-items")
    ended = run_rounds(thin_items(items, check, repair, gate), check, repair, rounds, stage, gate, partitions, kept)
    return with_outcome(items, ended.rows(), [ended])


def numbered(items: DataFrame) -> DataFrame:
    return items.withColumn(ITEM, F.monotonically_increasing_id())


#: What rounds know of an item beside its number.
STATE = ("text", "repairs", "outcome")


def thin_items(items: DataFrame, *functions: Callable | None) -> DataFrame:
    """Items with their number, state, and the columns that these functions read."""
    used = [fn for fn in functions if fn is not None]
    if all(hasattr(fn, "reads") for fn in used):
        read = {column for fn in used for column in fn.reads}
    else:
        read = set(items.columns) - {"events"}
    return items.select(ITEM, *STATE, *[column for column in items.columns if column in read and column not in (ITEM, *STATE)])


class Ended:
    """How items end, and what happened to them, as tables by item number."""

    def __init__(self):
        self.pieces: list[DataFrame] = []
        self.happened: list[DataFrame] = []

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.pieces)


def with_outcome(items: DataFrame, ended: DataFrame, stages: list[Ended], extra: list[str] | None = None) -> DataFrame:
    """Items with the text, repairs and outcome they ended with, and all their events in order."""
    happened = [rows.withColumn("stage", F.lit(number)) for number, stage in enumerate(stages) for rows in stage.happened]
    told = reduce(DataFrame.unionByName, happened).groupBy(ITEM).agg(
        F.flatten(F.sort_array(F.collect_list(F.struct("stage", "step", "told")))["told"]).alias("_told"))
    columns = [column for column in items.columns if column != ITEM]
    out = items.drop(*STATE).join(ended.select(ITEM, *STATE, *(extra or [])), ITEM).join(told, ITEM, "left")
    events = F.concat("events", F.coalesce("_told", F.array().cast(f"array<{EVENT}>")))
    return out.withColumn("events", events).select(*columns, *(extra or []))


def _judged(checked: DataFrame, stage: Stage, number: int, last: bool, gated: bool) -> DataFrame:
    """Checked items with ``ended``, their state, and ``told``: what the round says of them.

    Cases are tried in order; an item that meets none stays pending, or has failed in the last round.
    """
    known = _with_default(checked, "check_error", "string")
    # a check that gives no code is an error, so that no item is lost
    known = known.withColumn("check_error", F.coalesce("check_error", F.when(F.col("checked.code").isNull(), F.lit(NO_RESULT))))
    text, error, code = F.col("text"), F.col("check_error"), F.col("checked.code")
    before, repairs = F.col("repairs"), F.lit(number) if number else F.col("repairs")
    cases = []
    if number:
        no_repair = F.array(_event(event_name(stage.no_repair, F.lit(number)), 1))
        cases.append((F.col("repaired").isNull(), True, REPAIR_FAILED, F.col("_old_text"), before, no_repair))
    if number and gated:
        gate_error, new = F.col("_gate_error"), F.col("_new_text")
        refused = F.array(_event(event_name(stage.gate_failed, F.lit(number)), 1),
                          _event(event_name(stage.failed, F.lit(number - 1)), 1, F.col("_old.output")))
        cases += [(gate_error.isNotNull(), True, OTHER, new, before, F.array(_event(F.lit(OTHER_ERROR), 1, gate_error))),
                  (F.col("_gate.code") != 0, True, stage.outcome_failed, new, before, refused)]
    failed = F.array(_event(event_name(stage.failed, repairs), 1, F.col("checked.output")))
    cases += [
        (error.isNotNull(), True, OTHER, text, repairs, F.array(_event(F.lit(OTHER_ERROR), 1, error))),
        (code == 0, True, stage.outcome_passed, text, repairs, F.array(_event(event_name(stage.passed, repairs), 0))),
        (F.lit(True), last, stage.outcome_failed if last else None, text, repairs, failed if last else F.array()),
    ]
    verdict = None
    for condition, ended, outcome, its_text, its_repairs, told in cases:
        value = F.struct(
            F.lit(ended).alias("ended"), its_text.alias("text"), its_repairs.cast("int").alias("repairs"), F.lit(outcome).cast("string").alias("outcome"),
            told.cast(f"array<{EVENT}>").alias("told"))
        verdict = F.when(condition, value) if verdict is None else verdict.when(condition, value)
    out = known.withColumn("_verdict", verdict)
    told = F.col("_verdict.told")
    if number:
        told = F.concat(F.coalesce("repair_events", F.array().cast(f"array<{EVENT}>")), told)
    work = ("repaired", "repair_events", "_old_text", "_old", "_gate", "_gate_error", "_new_text", "_verdict", "output")
    return out.withColumns({**{name: F.col(f"_verdict.{name}") for name in ("ended", *STATE)}, "told": told}).drop(*work)


def run_rounds(items: DataFrame, check: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], rounds: int,
               stage: Stage, gate: Callable[[DataFrame], DataFrame] | None, partitions: int | None, kept: Steps | Unnamed) -> Ended:
    """The rounds over thin items; steps are named by stage and round."""
    ended = Ended()
    busy = items.where(F.col("outcome").isNull())
    if partitions is not None:
        busy = busy.repartition(partitions)
    ended.pieces.append(items.where(F.col("outcome").isNotNull()))
    pending = busy
    for number in range(rounds + 1):
        if number and pending.isEmpty():
            break
        failing = pending

        def repaired() -> DataFrame:
            asked = _with_default(repair(failing.withColumn("output", F.col("checked.output"))), "repair_events", f"array<{EVENT}>")
            return asked.withColumns({
                "repaired": F.nullif(F.col("repaired"), F.lit("")), "_old_text": F.col("text"), "_old": F.col("checked"),
            }).withColumn("text", F.col("repaired")).drop("checked", "check_error")

        def gated() -> DataFrame:
            passed = _with_default(gate(repaired()), "check_error", "string")
            no_code = F.when(F.col("checked.code").isNull(), F.lit(NO_RESULT))
            return passed.withColumns({
                "_gate": F.col("checked"), "_gate_error": F.coalesce("check_error", no_code), "_new_text": F.col("text"),
                "text": F.when(F.col("checked.code") == 0, F.col("text")),
            }).drop("checked", "check_error")

        def judged() -> DataFrame:
            if number == 0:
                made = failing
            else:
                made = repaired() if gate is None else kept.keep(gated, f"{stage.name}-gate-{number}")
            return _judged(check(made), stage, number, number == rounds, gate is not None)

        done = kept.keep(judged, f"{stage.name}-check-{number}")
        ended.pieces.append(done.where("ended").select(*items.columns))
        ended.happened.append(done.select(ITEM, F.lit(number).alias("step"), "told"))
        pending = done.where("NOT ended").select(*items.columns, "checked", "check_error")
    return ended


def _with_default(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def to_events(items: DataFrame, project: str = "project", item_id: str = "method_id") -> DataFrame:
    """Event rows of items, in the columns of the log (I4); an item can have several."""
    return items.select(
        F.col(project).alias("project_name"), F.col(item_id).alias("method_id"), F.posexplode("events").alias("ord", "e")
    ).select("project_name", "method_id", "ord", "e.event", "e.result_code", "e.add_info")


def outcome_counts(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Items per outcome."""
    return items.groupBy(*(by or []), "outcome").agg(F.count(F.lit(1)).alias("n"))
