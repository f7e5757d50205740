"""Check-and-repair rounds, row by row, and the whole job with stubs."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from unitloom.plans import generate, rounds
from unitloom.plans.context import gather_context
from unitloom.session import Steps, Unnamed


def digits_check(bad):
    """Fails while the first character is in ``bad``."""
    def check(text):
        hit = text.substr(1, 1).isin(list(bad))
        return F.struct(F.when(hit, 1).otherwise(0).alias("code"), F.when(hit, F.concat(text, F.lit("\nbad"))).otherwise("").alias("output"))
    return rounds.column_check(check)


def pop(df):
    """A repair that drops the first character; '' means no repair."""
    return df.withColumn("repaired", F.expr("substring(text, 2)"))


def items(spark, texts):
    return rounds.start_items(spark.createDataFrame(list(enumerate(texts, 1)), "method_id bigint, text string").withColumn("project", F.lit("p")))


def shown(df):
    return {r.method_id: (r.text, r.outcome, r.repairs, [(e.event, e.result_code, e.add_info) for e in r.events]) for r in df.collect()}


def test_first_stage(spark):
    made = shown(rounds.repair_rounds(items(spark, ["o", "xo", "xxo", "xxxo", "x"]), digits_check("x"), pop, 2))
    assert made == {
        1: ("o", None, 0, [("Compilation Successful Round 0", 0, "")]),
        2: ("o", None, 1, [("Compilation Successful Round 1", 0, "")]),
        3: ("o", None, 2, [("Compilation Successful Round 2", 0, "")]),
        4: ("xo", "compile_error", 2, [("Compilation Error Round 2", 1, "xo bad")]),
        5: ("x", "repair_error", 0, [("Compilation Repair Prompt Construction Error Round 1", 1, "")]),
    }


def test_second_stage_with_gate(spark):
    made = shown(rounds.repair_rounds(items(spark, ["o", "yo", "yxo", "yyxo", "yyyo", "y"]), digits_check("y"), pop, 2,
                                      rounds.EXECUTION_STAGE, gate=digits_check("x")))
    failed = "Execution Error after after {} repairs"
    assert made == {
        1: ("o", "passed", 0, [("Execution Successful after 0 repairs", 0, "")]),
        2: ("o", "passed", 1, [("Execution Successful after 1 repairs", 0, "")]),
        3: ("xo", "execution_error", 0, [("Compilation Error during Execution Repair Round 1", 1, ""), (failed.format(0), 1, "yxo bad")]),
        4: ("xo", "execution_error", 1, [("Compilation Error during Execution Repair Round 2", 1, ""), (failed.format(1), 1, "yxo bad")]),
        5: ("yo", "execution_error", 2, [(failed.format(2), 1, "yo bad")]),
        6: ("y", "repair_error", 0, [("Execution Repair Prompt Construction Error Round 1", 1, "")]),
    }


def test_no_rounds_and_ended_items(spark):
    ended = items(spark, ["xo", "o"]).withColumn("outcome", F.when(F.col("method_id") == 2, "answer_error"))
    made = shown(rounds.repair_rounds(ended, digits_check("x"), pop, 0))
    assert made[1][1] == "compile_error" and made[2] == ("o", "answer_error", 0, [])


def test_python_check_and_errors(spark):
    def make():
        def check(text):
            if text == "late":
                raise TimeoutError
            if text == "crash":
                raise RuntimeError("boom")
            return (0, "fine") if text == "good" else (1, "bad")
        return check

    made = shown(rounds.repair_rounds(items(spark, ["good", "late", "crash", "other"]), rounds.row_check(make), pop, 0))
    assert made[1][3] == [("Compilation Successful Round 0", 0, "")]
    assert made[2][3] == [("Compilation Error Round 0", 1, "Timeout")]
    assert made[3][1:] == ("other_error", 0, [("Other Error", 1, "boom")])
    assert made[4][1] == "compile_error"


def test_infer_tries_again(spark):
    def make():
        seen = Counter()

        def answer(prompt):
            seen[prompt] += 1
            if seen[prompt] < int(prompt):
                raise ValueError(f"try {seen[prompt]}")
            return f"after {seen[prompt]}"
        return answer

    df = spark.createDataFrame([("1",), ("3",), ("4",), (None,)], "prompt string")
    made = {r.prompt: (r.answer, r.error) for r in rounds.infer(df, "prompt", make, max_tries=3, partitions=2).collect()}
    assert made == {"1": ("after 1", None), "3": ("after 3", None), "4": (None, "try 3"), None: (None, None)}


def test_model_is_asked_once(spark, tmp_path):
    """Every answer is written before it is used: a model leaves one mark per prompt."""
    marks = str(tmp_path)

    def make():
        import uuid

        def answer(prompt):
            open(f"{marks}/{uuid.uuid4().hex}", "w").close()
            return "```java\nxx class A {}\n```"
        return answer

    start = items(spark, ["x1", "x2", "x3"]).withColumn("package", F.lit(""))
    repair = generate.model_repair(make, "{method_text} {error_message}")
    made = rounds.repair_rounds(start, digits_check("x"), repair, 2)
    assert made.count() == 3 and made.count() == 3
    assert len(list(tmp_path.iterdir())) == 6


def shop(spark):
    classes = [("p", "a.b", "A", "class A", "head A", "import x;", "p/java/a/b/A.java"), ("p", "a.b", "B", "class B text", "", "", "p/none/B.java")]
    methods = [("p", "a.b", i, n, c, f"code of {n}") for i, n, c in
               [(1, "run", "A"), (2, "big", "A"), (3, "lost", "B"), (4, "mute", "A"), (5, "nameless", "A"), (6, "down", "A")]]
    edges = [("p", 1, 3, 0), ("p", 1, 1, 1), ("p", 1, 3, 2)] + [("p", 2, 1, i) for i in range(500)]
    return {
        "classes": spark.createDataFrame(classes, "project string, package string, class_identifier string, full_text string,"
                                                  " header string, imports string, filepath string"),
        "methods": spark.createDataFrame(methods, "project string, package string, method_id bigint, method_identifier string,"
                                                  " class_identifier string, full_text string"),
        "related_methods": spark.createDataFrame(edges, "project string, source_id bigint, target_id bigint, ord int"),
        "related_classes": spark.createDataFrame([("p", 1, "a.b", "B", 0)], "project string, method_id bigint, package string,"
                                                                            " class_identifier string, ord int"),
    }


def test_context(spark):
    made = {r.method_id: r for r in gather_context(shop(spark), 400).collect()}
    assert {k: r.level for k, r in made.items()} == {1: 4, 2: 2, 3: 4, 4: 4, 5: 4, 6: 4}
    assert ("Related methods: \n\nMethod: lost of the class B:\n```java\ncode of lost\n```\nMethod: run of the class A:\n```java\ncode of run"
            "\n```\nMethod: lost of the class B:\n```java\ncode of lost\n```\n\n\nRelated classes: \n\n```java\nclass B text\n```\n") in made[1].prompt
    assert "Related methods: \n\nNo relations found.\n" in made[3].prompt
    for row in made.values():
        assert row.tokens == len(row.prompt.split()) < 400
    assert [r.level for r in gather_context(shop(spark), 5, only=F.col("method_id") == 1).collect()] == [0]
    # two templates that do not add up, and a budget only the first level meets
    odd = ("{method_code}", "({related_methods})")
    assert {r.method_id: r.level for r in gather_context(shop(spark), 40, odd).collect()} == {1: 2, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2}


def test_whole_job(spark):
    def make():
        def answer(prompt):
            name = prompt.split("Method: ")[1].split("\n")[0]
            if name == "down":
                raise ConnectionError("no service")
            if name == "big":
                raise TimeoutError
            return {"mute": "sorry", "nameless": "```\nint x;\n```"}.get(name, "```java\npackage q;\nclass T { T() }\n```")
        return answer

    fine = rounds.column_check(lambda text: F.struct(F.lit(0).alias("code"), F.lit("").alias("output")))
    made = generate.generate_units(shop(spark), make, fine, fine, "R", runs=2, budget=400)
    rows = {(r.method_id, r.run): r for r in made.collect()}
    assert len(rows) == 12
    outcome = {k: (r.outcome, [e.event for e in r.events]) for k, r in rows.items()}
    passed = ("passed", ["Compilation Successful Round 0", "Execution Successful after 0 repairs"])
    for run in (1, 2):
        assert outcome[1, run] == passed
        assert outcome[2, run] == ("other_error", ["Timeout Error"])
        assert outcome[3, run] == ("other_error", ["Other Error"])  # its path has no source root
        assert outcome[4, run] == ("answer_error", ["No Source Code in Answer Error", "Answer Extraction Error"])
        assert outcome[5, run] == ("answer_error", ["Class Name Extraction Error"])
        assert outcome[6, run] == ("other_error", ["Other Error"])
    assert rows[1, 1].text == "package a.b;\n\nclass ATest_Method_1_Run_R { ATest_Method_1_Run_R() }"
    assert rows[1, 1].paths.passed_filepath == "build/generated_tests/p/passed/a/b"
    assert rows[6, 2].events[0].add_info == "no service"
    log = rounds.to_events(made)
    assert log.count() == sum(len(r.events) for r in rows.values())
    low = generate.generate_units(shop(spark), make, fine, fine, "R", budget=5)
    assert {(r.outcome, len(r.events)) for r in low.collect()} == {("over_budget", 0)}


def marking(folder, answer):
    """Maker of a model that leaves a mark per call."""
    def make():
        import uuid

        def asked(prompt):
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return answer(prompt)
        return asked
    return make


def test_killed_tasks_ask_only_what_is_not_filed(spark, tmp_path):
    """A worker dies in the midst of its questions; the next run asks the one it died on, and what was never asked."""
    (tmp_path / "marks").mkdir()
    flag = tmp_path / "armed"
    flag.touch()

    def answer(prompt, flag=str(flag)):
        if prompt == "p7" and os.path.exists(flag):
            os.remove(flag)
            os._exit(3)
        return prompt.upper()

    # a third of the rows share a prompt, and equal prompts of other runs are other questions
    rows = [(i, f"p{i % 10 if i % 3 else 0}" if i != 5 else None, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, prompt string, run int")
    ask = lambda: rounds.infer(df, "prompt", marking(tmp_path / "marks", answer), ledger=str(tmp_path / "ledger"), apart=["run"], partitions=2)
    with pytest.raises(Exception):
        ask().collect()
    first = len(os.listdir(tmp_path / "marks"))
    found = {r.id: (r.answer, r.error) for r in ask().collect()}
    assert found == {i: (p and p.upper(), None) for i, p, _ in rows}
    questions = len({(p, run) for _, p, run in rows if p})
    # asked again: at most the question it died on, and one of each other task that was cut off
    assert questions < len(os.listdir(tmp_path / "marks")) <= questions + 2 and first <= questions
    again = len(os.listdir(tmp_path / "marks"))
    assert ask().where("answer is not null").count() == 59 and len(os.listdir(tmp_path / "marks")) == again


def test_ledger_keeps_errors_apart(spark, tmp_path):
    def make():
        def answer(prompts):
            assert len(prompts) <= 4
            if "bad" in prompts:
                raise ValueError("no")
            return [p * 2 for p in prompts]
        return answer

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "bad", None, "a", "ü\n\"", ""])], "id int, prompt string")
    for _ in range(2):
        made = rounds.infer(df, "prompt", make, at_once=4, ledger=str(tmp_path / "l"))
        assert made.columns == ["id", "prompt", "answer", "error"]
        found = {r.id: (r.answer, r.error) for r in made.collect()}
        assert found == {0: ("aa", None), 1: ("bb", None), 2: (None, "no"), 3: (None, None), 4: ("aa", None), 5: ("ü\n\"ü\n\"", None), 6: ("", None)}
    assert rounds.infer(df.where("false"), "prompt", make, ledger=str(tmp_path / "l")).count() == 0


def test_native_calls_that_ignore_signals_are_ended(spark):
    """One call sleeps in native code, holding the interpreter, with signals ignored; one ends its process; later rows are checked."""
    def make():
        import ctypes
        import os
        import signal

        def check(text):
            if text == "hang":
                for number in (signal.SIGALRM, signal.SIGTERM, signal.SIGINT):
                    signal.signal(number, signal.SIG_IGN)
                ctypes.PyDLL(None).sleep(60)
            if text == "die":
                os._exit(7)
            if text == "loud":
                print("noise" * 1000)
            return 0, text * 2
        return check

    texts = ["a", "hang", "b", "die", "loud", "hang", "c" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    start = time.monotonic()
    found = {r.id: r for r in rounds.row_check(make, time_limit=1.5)(df).collect()}
    assert time.monotonic() - start < 45
    assert [tuple(found[i].checked) for i in (0, 1, 2, 4, 5, 6)] == [
        (0, "aa"), (1, "Timeout"), (0, "bb"), (0, "loudloud"), (1, "Timeout"), (0, "c" * 600_000)]
    assert found[3].checked is None and "ended with" in found[3].check_error


def test_a_stopped_job_goes_on(spark, tmp_path):
    """The job stops in round 2; started again it has the rows, events and calls of one that never stopped."""
    def job(place, flag):
        (tmp_path / place).mkdir()

        def make():
            import os

            def check(text):
                if text == "xo" and os.path.exists(flag):
                    raise SystemExit(1)
                return (1, "bad") if text.startswith("x") else (0, "")
            return check

        asks = rounds.reading(lambda df: rounds.infer(
            df, "text", marking(tmp_path / place, lambda text: text[1:]), answer="repaired", ledger=str(tmp_path / f"{place}-ledger")).drop("error"))
        start = items(spark, ["o", "xo", "xxo", "xxxo", "x", "xxxx"])
        return lambda: shown(rounds.repair_rounds(start, rounds.row_check(make), asks, 2, steps=Steps(spark, str(tmp_path / f"{place}-steps"))))

    flag = tmp_path / "flag"
    whole = job("whole", str(flag))()
    flag.touch()
    stopped = job("stopped", str(flag))
    with pytest.raises(BaseException):
        stopped()
    flag.unlink()
    assert stopped() == whole and stopped() == whole
    assert len(os.listdir(tmp_path / "stopped")) == len(os.listdir(tmp_path / "whole")) > 0
    finished = Steps(spark, str(tmp_path / "stopped-steps")).finished
    assert list(sorted(finished)) == ["compile-check-0", "compile-check-1", "compile-check-2", "compile-items"]


def test_rounds_carry_no_prompt(spark, tmp_path, monkeypatch):
    """Prompts are written once; items and rounds are written without them, and rounds without paths and events too."""
    written = {}
    keep = Unnamed.keep
    monkeypatch.setattr(Unnamed, "keep", lambda self, make, name: written.setdefault(name, keep(self, make, name)))

    def make():
        return lambda prompt: "```java\nclass T { bad }\n```" if "error" not in prompt else "```java\nclass T { }\n```"

    bad = rounds.column_check(lambda text: F.struct(F.when(text.contains("bad"), 1).otherwise(0).alias("code"), F.lit("error").alias("output")))
    made = generate.generate_units(shop(spark), make, bad, bad, "R", runs=2, budget=400)
    assert {r.outcome for r in made.collect()} == {"passed", "other_error"} and "prompt" in made.columns
    assert [name for name, df in written.items() if "prompt" in df.columns] == ["prompts"]
    steps = [df for name, df in written.items() if "-check-" in name or "-gate-" in name]
    assert len(steps) >= 3 and all({"_item", "text"} <= set(df.columns) and not {"paths", "events", "filepath"} & set(df.columns) for df in steps)


def test_a_whole_job_goes_on(spark, tmp_path):
    """A job with a folder of its own is run twice: the second run asks nothing and gives the same rows."""
    (tmp_path / "marks").mkdir()
    answer = lambda prompt: "```java\nclass T { }\n```"
    fine = rounds.column_check(lambda text: F.struct(F.lit(0).alias("code"), F.lit("").alias("output")))
    run = lambda: sorted(map(str, generate.generate_units(shop(spark), marking(tmp_path / "marks", answer), fine, fine, "R", budget=400,
                                                          folder=str(tmp_path / "job")).collect()))
    first = run()
    asked = len(os.listdir(tmp_path / "marks"))
    assert run() == first and len(os.listdir(tmp_path / "marks")) == asked == 6


def test_class_names_come_from_trees(spark):
    """With a parser, the class of an answer is its first top-level one, not what a pattern takes for one."""
    from unitloom.proofs.facts import brace_parser

    def make():
        return lambda prompt: "```java\ninterface I { class Nested { } }\nclass Real { Real() }\n```" if "Method: run" in prompt else "```java\nenum E { }\n```"

    fine = rounds.column_check(lambda text: F.struct(F.lit(0).alias("code"), F.lit("").alias("output")))
    only = (F.col("method_id") == 1) | (F.col("method_id") == 4)
    by_tree, by_pattern = [
        {r.method_id: r for r in generate.generate_units(shop(spark), make, fine, fine, "R", only=only, budget=400, make_parser=parser).collect()}
        for parser in (brace_parser(), None)]
    name = "ATest_Method_1_Run_R"
    assert by_tree[1].text.endswith(f"interface I {{ class Nested {{ }} }}\nclass {name} {{ {name}() }}") and by_tree[1].outcome == "passed"
    assert "class Real" in by_pattern[1].text
    assert by_tree[4].outcome == "answer_error" and [e.event for e in by_tree[4].events] == ["Class Name Extraction Error"]
    assert set(by_tree[1].asDict()) == set(by_pattern[1].asDict())
