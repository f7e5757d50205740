"""Column functions against plain Python on small texts."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from unitloom.functions import templates, text as X, tokens

PATTERN = re.compile(X.FENCED_BLOCK)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


ANSWERS = {
    "a\n```java\none\n```\nb\n```\ntwo\n```": "two", "no block": None, "```\n\n```": "", "```java\nopen": None,
    "```java\nclass A {}\n```": "class A {}", "``\nx\n``": None,
}


def test_blocks(spark):
    found = values(spark, [(a,) for a in ANSWERS], "t string", "t", X.code_blocks(F.col("t")), X.last_block(F.col("t")))
    for answer, blocks, last in found:
        assert blocks == PATTERN.findall(answer)
        assert last == ANSWERS[answer]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="`a\n j", max_size=40), min_size=20, max_size=20))
def test_blocks_like_findall(spark, texts):
    for text, blocks in values(spark, [(t,) for t in texts], "t string", "t", X.code_blocks(F.col("t"))):
        assert blocks == PATTERN.findall(text)


@pytest.mark.parametrize("text, package, wanted", [
    ("class A {}", "a.b", "package a.b;\n\nclass A {}"),
    ("package old;\nclass A {}", "a.b", "package a.b;\n\nclass A {}"),
    (" package old;\nx", "a", "package a;\n\n package old;\nx"),
    ("package old;\nx", "", "x"),
])
def test_package(spark, text, package, wanted):
    assert values(spark, [(text, package)], "t string, p string", X.set_package(F.col("t"), F.col("p"))) == [(wanted,)]


def test_paths(spark):
    paths = ["p/src/main/java/a/b/A.java", "p/java/a/A.java", "p/java/A.java", "p/A.java", "java/java/x/A.java"]
    found = values(spark, [(p,) for p in paths], "p string", X.package_from_path(F.col("p")))
    assert [f for f, in found] == ["a.b", "", "", None, "java.x"]
    made = X.target_paths(F.col("p"), F.lit("P"))
    (first,), = values(spark, [(paths[0],)], "p string", made)
    assert first.asDict() == {
        "execution_filepath": "build/generated_tests/P/execution/a/b", "passed_filepath": "build/generated_tests/P/passed/a/b",
        "compile_error_filepath": "build/generated_tests/P/compile_error/a/b",
        "execution_error_filepath": "build/generated_tests/P/execution_error/a/b",
        "compile_filepath": "build/compiled_tests/P/a/b", "prompt_path": "build/prompts/P/a/b"}


def test_class_names(spark):
    texts = {"public class Foo<T> {}": "Foo", "// class Not\nfinal class Grüße{}": "Grüße", "/* class No */ interface I {}": None,
             "subclass x": None, "class\n A extends B": "A"}
    found = values(spark, [(t,) for t in texts], "t string", "t", X.first_class_name(F.col("t")))
    assert dict(found) == texts
    named = X.unique_class_name(F.lit("Own"), F.lit(7), "r")
    assert values(spark, [("class Foo { Foo() }",), ("none",)], "t string", X.rename_class(F.col("t"), named)) == [
        ("class OwnTest_Method_7_Run_r { OwnTest_Method_7_Run_r() }",), (None,)]


def test_small_ones(spark):
    assert values(spark, [(" a = b = c",), ("\tx\n",)], "t string", X.declarator_name(F.col("t"))) == [("a",), ("x",)]
    assert values(spark, [("a\r\nb",), (None,)], "t string", X.clean_info(F.col("t"))) == [("a b",), ("",)]
    content = X.utf8(F.col("t"))
    assert values(spark, [("aüb",)], "t string", X.node_text(content, F.lit(1), F.lit(3)), X.node_text(content, F.lit(3), F.lit(4))) == [("ü", "b")]
    assert X.run_id(spark, "given") == "given" and re.fullmatch(r"\d{8}_\d{6}", X.run_id(spark))


def test_levels(spark):
    cases = {(5, 8, 3, 9): 4, (20, 1, 1, 1): 0, (5, 12, 3, 4): 1, (10, 1, 1, 1): 0}
    level = tokens.choose_level([F.col(c) for c in "abcd"], 10)
    assert [f for f, in values(spark, list(cases), "a int, b int, c int, d int", level)] == list(cases.values())


def test_rendering_is_not_repeated(spark):
    made = templates.render_template("<{a}|{b}>", {"a": F.col("x"), "b": F.col("y")})
    assert values(spark, [("{b}", None)], "x string, y string", made) == [("<{b}|None>",)]


def test_token_parts():
    for template, wanted in [("x {a} y", (2, ["a"])), ("x{a} y", None), ("{a}", (0, ["a"])), ("{a}{b}", None), ("{a}.", None),
                             ("{s} and {s}, {a}\n", (3, ["a"]))]:
        class Anything:
            pass
        values_of = {"a": Anything(), "b": Anything(), "s": "one"}
        assert templates.token_parts(template, values_of) == wanted, template


def test_custom_tokens(spark):
    counter = tokens.TokenCounter(lambda: len, max_chars_per_token=1)
    assert values(spark, [("abc",), ("",), (None,)], "t string", tokens.count_tokens(F.col("t"), counter)) == [(3,), (0,), (None,)]


def test_repair_prompt(spark):
    prompt = templates.repair_prompt(F.col("t"), F.lit("err"), budget=10_000)
    (made,), = values(spark, [("CODE",)], "t string", prompt)
    assert "compile error:\nerr\n" in made and "```java\nCODE\n```" in made and made.endswith("[\\INST]\n\n[AI]:\n")
    small = templates.repair_prompt(F.col("t"), F.lit("err"), budget=5, template=templates.EXECUTION_REPAIR)
    assert values(spark, [("CODE",)], "t string", small) == [("",)]
