"""Scalar functions over source texts, answers, paths and log fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# These patterns and names must be exactly so for results to agree.
FENCED_BLOCK = r"```(?:[^`\n]+)?\n([\s\S]*?)\n```"
SOURCE_ROOT = "java"
TARGET_FOLDERS = {
    "execution_filepath": ["build", "generated_tests", "{project}", "execution"],
    "passed_filepath": ["build", "generated_tests", "{project}", "passed"],
    "compile_error_filepath": ["build", "generated_tests", "{project}", "compile_error"],
    "execution_error_filepath": ["build", "generated_tests", "{project}", "execution_error"],
    "compile_filepath": ["build", "compiled_tests", "{project}"],
    "prompt_path": ["build", "prompts", "{project}"],
}


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# --- answers -------------------------------------------------------------------------

def code_blocks(text: Column) -> Column:
    """All fenced blocks of a text, in order (F1)."""
    return F.regexp_extract_all(text, F.lit(FENCED_BLOCK), F.lit(1))


def last_block(text: Column) -> Column:
    """Last fenced block; null if there is none, '' if it is empty."""
    return F.try_element_at(code_blocks(text), F.lit(-1))


def drop_lines(text: Column, prefix: str | Column) -> Column:
    """Drop the lines that start with ``prefix`` (F2)."""
    start = _lit(prefix)
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.startswith(start)), "\n")


def set_package(text: Column, package: Column) -> Column:
    """Put ``package`` in front of a unit, in place of any package line it has.

    The default package ('') has no declaration, so none is written for it.
    """
    body = F.when(text.contains("package"), drop_lines(text, "package")).otherwise(text)
    line = F.when(package == "", F.lit("")).otherwise(F.concat(F.lit("package "), package, F.lit(";\n\n")))
    return F.concat(line, body)


def first_class_name(text: Column) -> Column:
    """Name after the first ``class`` keyword outside comments; null if none.

    A pattern: it also takes a class in a string or inside an interface.  :func:`unitloom.plans.extract.class_names` reads the tree.
    """
    bare = F.regexp_replace(text, r"/\*[\s\S]*?\*/|//[^\n]*", " ")
    return F.nullif(F.regexp_extract(bare, r"(?:^|[\s;{}@)])class\s+([^\s{<(;]+)", 1), F.lit(""))


def unique_class_name(owner: Column, unit_id: Column, run_id: Column | str) -> Column:
    """``{owner}Test_Method_{id}_Run_{run}``."""
    return F.concat(owner, F.lit("Test_Method_"), unit_id.cast("string"), F.lit("_Run_"), _lit(run_id).cast("string"))


def rename_class(text: Column, new_name: Column, own_name: Column | None = None) -> Column:
    """Replace every occurrence of the text's own class name, by default found by pattern; null if it has none."""
    return F.replace(text, first_class_name(text) if own_name is None else own_name, new_name)


# --- paths ---------------------------------------------------------------------------

def path_below_source_root(path: Column, root: str = SOURCE_ROOT) -> Column:
    """Folders between the first ``root`` component and the file name; null without one."""
    parts = F.split(path, "/", -1)
    at = F.array_position(parts, root)
    return F.when(at > 0, F.slice(parts, (at + 1).cast("int"), (F.size(parts) - at - 1).cast("int")))


def package_from_path(path: Column, root: str = SOURCE_ROOT) -> Column:
    """Dotted package of a file; '' below two folders, null without a source root."""
    folders = path_below_source_root(path, root)
    return F.when(F.size(folders) > 1, F.array_join(folders, ".")).when(folders.isNotNull(), F.lit(""))


def target_paths(path: Column, project: Column, root: str = SOURCE_ROOT) -> Column:
    """The six folders a unit's files go to, as a struct."""
    folders = path_below_source_root(path, root)
    made = []
    for name, prefix in TARGET_FOLDERS.items():
        head = [project if part == "{project}" else F.lit(part) for part in prefix]
        made.append(F.array_join(F.concat(F.array(*head), folders), "/").alias(name))
    return F.struct(*made)


# --- syntax text ---------------------------------------------------------------------

def declarator_name(text: Column) -> Column:
    """Name of a declarator: what stands before '=' (F12)."""
    return strip(F.split_part(text, F.lit("="), F.lit(1)))


def utf8(text: Column) -> Column:
    return F.encode(text, "utf-8")


def node_text(content_bytes: Column, start: Column, end: Column) -> Column:
    """Text of a node by byte offsets into UTF-8 content, see :func:`utf8`."""
    return F.decode(F.substring(content_bytes, start.cast("int") + 1, (end - start).cast("int")), "utf-8")


# --- checks and events ---------------------------------------------------------------

def compile_output(code: Column, stdout: Column, stderr: Column) -> Column:
    """Output of a compiler: stdout on success, else stderr (F16)."""
    return F.when(code == 0, stdout).otherwise(stderr)


def run_output(stdout: Column, stderr: Column) -> Column:
    """Output of a run: stdout, or stderr where stdout is empty (F16)."""
    return F.coalesce(F.nullif(stdout, F.lit("")), stderr)


def or_timeout(result: Column, timed_out: Column) -> Column:
    """A result struct (code, output), replaced by (1, 'Timeout') where time ran out."""
    late = F.struct(F.lit(1).alias("code"), F.lit("Timeout").alias("output"))
    return F.when(timed_out, late).otherwise(result)


def clean_info(text: Column) -> Column:
    """One-line form of a log text; null counts as '' (F18)."""
    return F.coalesce(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")), F.lit(""))


def event_name(pattern: str, number: Column) -> Column:
    """Event name with a round number in place of ``{n}``."""
    before, _, after = pattern.partition("{n}")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after)) if "{n}" in pattern else F.lit(pattern)


def run_id(spark, given: str | None = None) -> str:
    """Id of a job's run: ``given``, or the session's time, read once."""
    return given or spark.sql("select date_format(current_timestamp(), 'yyyyMMdd_HHmmss') as id").first().id
