"""Inference, check-and-repair rounds, events and outcomes over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitloom.functions.templates import LEVELS
from unitloom.plans import generate, rounds
from unitloom.proofs.context import shop_tables
from unitloom.proofs.registry import proof, table


@proof("""
    select conv_id, turn, case when role <> 'system' then length(text) || ':' || md5(text) end as answer,
           case when role = 'system' then 'no answer to ' || length(text) end as error
    from conversations
""")
def infer(spark, folder):
    """A model that fails on some rows: those carry the error, the others their answer."""
    def make():
        import hashlib

        def answer(row):
            if row["role"] == "system":
                raise ValueError(f"no answer to {len(row['text'])}")
            return f"{len(row['text'])}:{hashlib.md5(row['text'].encode()).hexdigest()}"
        return answer

    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text", "role")
    found = rounds.per_row(turns, ["text", "role"], make, "string", "answer", max_tries=2)
    return found.select("conv_id", "turn", "answer", "error")


@proof("""
    select conv_id, turn, case when contains(text, 'tion') or length(text) < 40 then 1 else 0 end as code,
           case when contains(text, 'tion') then 'Timeout' when length(text) < 40 then 'short' else '' end as output
    from conversations
""")
def validate(spark, folder):
    """A check in Python that runs out of time on some rows."""
    def make():
        def check(text):
            if "tion" in text:
                raise TimeoutError
            return (1, "short") if len(text) < 40 else (0, "")
        return check

    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    checked = rounds.row_check(make)(turns)
    return checked.select("conv_id", "turn", "checked.code", "checked.output")


def priced_items(spark, folder):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return rounds.start_items(table(spark, folder, "orders").select(
        F.lit("shop").alias("project"), F.col("o_orderkey").alias("method_id"), cents.cast("string").alias("text")))


def below(limit):
    """Passes while the number in the text is below a limit."""
    def check(text):
        high = text.cast("bigint") >= limit
        return F.struct(F.when(high, 1).otherwise(0).alias("code"),
                        F.when(high, F.concat(text, F.lit(" is\nhigh"))).otherwise("").alias("output"))
    return rounds.column_check(check)


def halve(df):
    """Halves the number; gives nothing where it ends in 9."""
    half = F.expr("cast(cast(text as bigint) div 2 as string)")
    return df.withColumn("repaired", F.when(~F.col("text").endswith("9"), half))


PRICES = """
    with s0 as (select o_orderkey as id, cast(round(o_totalprice * 100) as bigint) as v from orders),
    {steps}
"""
_STEP = """
    s{n} as (select id, case when done then v when v % 10 = 9 then v else v // 2 end as v,
                    done or v % 10 = 9 as done, lost or (not done and v % 10 = 9) as lost, repairs + case when done or v % 10 = 9 then 0 else 1 end as repairs
             from d{m}),
    d{n} as (select id, v, done or v < 6000000 as done, lost, repairs from s{n})"""
_START = "d0 as (select id, v, v < 6000000 as done, false as lost, 0 as repairs from s0),"
COMPILED = PRICES.format(steps=_START + ",".join(_STEP.format(n=n, m=n - 1) for n in (1, 2, 3))) + """,
    compiled as (select id, v, cast(repairs as integer) as repairs,
        case when lost then 'repair_error' when v >= 6000000 then 'compile_error' end as outcome from d3)
"""


@proof(COMPILED + """
    select id as method_id, cast(v as varchar) as text, repairs, coalesce(outcome, 'ready') as outcome from compiled
""")
def repair_rounds(spark, folder):
    done = rounds.repair_rounds(priced_items(spark, folder), below(6_000_000), halve, 3,
                                partitions=spark.sparkContext.defaultParallelism)
    return done.select("method_id", "text", "repairs", F.coalesce("outcome", F.lit("ready")).alias("outcome"))


@proof(COMPILED + """,
    events as (
        select id, outcome, case when outcome is null then 'Compilation Successful Round ' || repairs
                        when outcome = 'compile_error' then 'Compilation Error Round ' || repairs
                        else 'Compilation Repair Prompt Construction Error Round ' || (repairs + 1) end as event, v from compiled)
    select 'shop' as project_name, id as method_id, event, cast(case when outcome is null then 0 else 1 end as integer) as result_code,
           case when outcome = 'compile_error' then v || ' is high' else '' end as add_info from events
""")
def event_rows(spark, folder):
    done = rounds.repair_rounds(priced_items(spark, folder), below(6_000_000), halve, 3,
                                partitions=spark.sparkContext.defaultParallelism)
    return rounds.to_events(done).select("project_name", "method_id", "event", "result_code", "add_info")


# the second stage: v passes below 2,000,000; a repair ends in nothing at 9, and in a text
# that the first check refuses where its last digit is 7
_RUN_STEP = """
    r{n} as (select id, v as old, repairs, outcome, n_events,
                    case when outcome is null and v % 10 <> 9 then (case when v % 10 = 7 then 9000000 else v // 2 end) else v end as v from e{m}),
    e{n} as (select id, v,
        case when outcome is not null then outcome when old % 10 = 9 then 'repair_error' when v >= 6000000 then 'execution_error'
             when v < 2000000 then 'passed' end as outcome,
        repairs + case when outcome is null and old % 10 <> 9 and v < 6000000 then 1 else 0 end as repairs,
        n_events + case when outcome is not null then 0 when old % 10 = 9 then 1 when v >= 6000000 then 2 when v < 2000000 then 1 else 0 end as n_events
        from r{n})"""
GATED = COMPILED + """,
    e0 as (select id, v, coalesce(outcome, case when v < 2000000 then 'passed' end) as outcome, 0 as repairs,
                  1 + case when outcome is null and v < 2000000 then 1 else 0 end as n_events from compiled),
""" + ",".join(_RUN_STEP.format(n=n, m=n - 1) for n in (1, 2)) + """,
    ended as (select id, v, coalesce(outcome, 'execution_error') as outcome, cast(repairs as integer) as repairs,
                     cast(n_events + case when outcome is null then 1 else 0 end as integer) as n_events from e2)
"""


def gated_items(spark, folder):
    def halve_or_break(df):
        half = F.expr("cast(cast(text as bigint) div 2 as string)")
        broken = F.when(F.col("text").endswith("7"), F.lit("9000000")).otherwise(half)
        return df.withColumn("repaired", F.when(~F.col("text").endswith("9"), broken))

    compiled = rounds.repair_rounds(priced_items(spark, folder), below(6_000_000), halve, 3,
                                partitions=spark.sparkContext.defaultParallelism)
    return rounds.repair_rounds(compiled.withColumn("repairs", F.lit(0)), below(2_000_000), halve_or_break, 2,
                                rounds.EXECUTION_STAGE, gate=below(6_000_000))


@proof(GATED + "select id as method_id, cast(v as varchar) as text, repairs, outcome, n_events from ended")
def gated_rounds(spark, folder):
    done = gated_items(spark, folder)
    return done.select("method_id", "text", "repairs", "outcome", F.size("events").alias("n_events"))


@proof(GATED + "select outcome, count(*) as n from ended group by outcome")
def routed_outcomes(spark, folder):
    return rounds.outcome_counts(gated_items(spark, folder))


def stub_model():
    """Answers by what the prompt holds; fixes what a repair prompt shows it."""
    def make():
        def answer(prompt):
            if "compile error" in prompt or "execution error" in prompt:
                code = prompt.rsplit("```java\n", 1)[1].split("\n```", 1)[0]
                fixed = code.replace("broken", "slow", 1) if "broken" in code else code.replace("slow", "fine", 1)
                return f"fixed:\n```java\n{fixed}\n```\n"
            name = prompt.split("\nMethod: ", 1)[1].split("\n", 1)[0]
            if not name.startswith("order"):
                return "I have no code for you."
            number = int(name[len("order"):])
            flaw = ("broken", "slow", "fine")[number % 3]
            return f"Here:\n```java\npackage old;\npublic class Made {{ // {flaw}\n  Made() {{}}\n}}\n```\n"
        return answer

    return make


@proof("""
    with m as (
        select o_orderkey as id, 'Customer' || o_custkey as cls, o_orderkey % 3 as k from orders),
    runs as (select id, cls, cast(run as integer) as run, ['fine', 'fine', 'fine'][k + 1] as flaw,
                    cast([1, 0, 0][k + 1] as integer) as compile_repairs, cast([1, 1, 0][k + 1] as integer) as repairs
             from m, (values (1), (2)) as t(run))
    select id as method_id, run, 'passed' as outcome, compile_repairs, repairs,
           'package java.src;' || chr(10) || chr(10) || repeat(chr(10), compile_repairs + repairs) || 'public class ' || cls || 'Test_Method_' || id || '_Run_r1 { // ' || flaw
           || chr(10) || '  ' || cls || 'Test_Method_' || id || '_Run_r1() {}' || chr(10) || '}' as text,
           array_to_string(list_concat(
               ['Compilation Successful Round ' || compile_repairs], ['Execution Successful after ' || repairs || ' repairs']), '|') as events
    from runs
    union all
    select -p_partkey - 1, cast(run as integer), 'answer_error', 0, 0, null,
           'No Source Code in Answer Error|Answer Extraction Error'
    from part, (values (1), (2)) as t(run)
""")
def generated_outcomes(spark, folder):
    """The whole job over orders and parts, with a stub for the model and column checks."""
    def lacks(flaw):
        def check(text):
            bad = text.contains(flaw)
            return F.struct(F.when(bad, 1).otherwise(0).alias("code"), F.when(bad, F.lit(flaw)).otherwise("").alias("output"))
        return rounds.column_check(check)

    tables = shop_tables(spark, folder)
    tables["classes"] = tables["classes"].withColumn("filepath", F.replace("filepath", F.lit("java/src/"), F.lit("java/java/src/")))
    brands = table(spark, folder, "part").select(F.col("p_brand").alias("class_identifier")).distinct()
    tables["classes"] = tables["classes"].unionByName(brands.select(
        F.lit("shop").alias("project"), F.lit("src").alias("package"), "class_identifier", F.lit("").alias("full_text"),
        F.lit("").alias("header"), F.lit("").alias("imports"), F.lit("shop/java/java/src/B").alias("filepath")))
    made = generate.generate_units(tables, stub_model(), lacks("broken"), lacks("slow"), "r1", runs=2, levels=LEVELS,
                                   compile_rounds=2, run_rounds=2, partitions=spark.sparkContext.defaultParallelism)
    return made.select("method_id", "run", "outcome", "compile_repairs", "repairs", "text",
                       F.array_join(F.col("events")["event"], "|").alias("events"))
