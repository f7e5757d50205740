"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from unitloom.functions import text as X
from unitloom.functions.templates import COMPILE_REPAIR, repair_prompt
from unitloom.functions.tokens import choose_level, fits_budget, token_count
from unitloom.proofs.registry import proof, table, template_sql, tokens_sql

FENCED = "'intro' || chr(10) || '```java' || chr(10) || text || chr(10) || '```' || chr(10) || 'then' || chr(10)" \
         " || '```' || chr(10) || role || chr(10) || '```' || chr(10)"
BLOCK_SQL = r"regexp_extract_all({}, '```(?:[^`\n]+)?\n([\s\S]*?)\n```', 1)"


def fenced_turns(spark, folder):
    fenced = F.concat(F.lit("intro\n```java\n"), "text", F.lit("\n```\nthen\n```\n"), "role", F.lit("\n```\n"))
    return table(spark, folder, "conversations").withColumn("answer", fenced)


@proof(f"""
    select conv_id, turn, cast(len(b) as integer) as n_blocks, md5(array_to_string(b, '|')) as blocks
    from (select conv_id, turn, {BLOCK_SQL.format(FENCED)} as b from conversations)
""")
def code_blocks(spark, folder):
    found = fenced_turns(spark, folder).withColumn("b", X.code_blocks(F.col("answer")))
    return found.select("conv_id", "turn", F.size("b").alias("n_blocks"), F.md5(F.array_join("b", "|")).alias("blocks"))


@proof("select conv_id, turn, case when role <> 'system' then role end as block from conversations")
def last_block(spark, folder):
    answer = F.when(F.col("role") == "system", F.col("text")).otherwise(F.col("answer"))
    return fenced_turns(spark, folder).select("conv_id", "turn", X.last_block(answer).alias("block"))


@proof("""
    select doc_id, md5(array_to_string([x for x in string_split(text, chr(10)) if not starts_with(x, 'The')], chr(10))) as kept
    from documents
""")
def drop_lines(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(X.drop_lines(F.col("text"), "The")).alias("kept"))


@proof("select doc_id, md5(replace(text, 'the', 'THE')) as replaced from documents")
def replaced_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(F.replace("text", F.lit("the"), F.lit("THE"))).alias("replaced"))


@proof("""
    select doc_id, md5(case when lang = 'fr' then '' else 'package ' || source || '.' || lang || ';' || chr(10) || chr(10) end
                       || text) as unit
    from documents
""")
def set_package(spark, folder):
    old = F.when(F.col("lang") == "en", F.concat(F.lit("package old.one;\n"), "text")).otherwise(F.col("text"))
    package = F.when(F.col("lang") == "fr", "").otherwise(F.concat_ws(".", "source", "lang"))
    return table(spark, folder, "documents").select("doc_id", F.md5(X.set_package(old, package)).alias("unit"))


PATH_CTE = """
    with parts as (select page_id, string_split(replace(url, '.', '/'), '/') as p from pages),
    placed as (select page_id, p, list_position(p, 'example') as i from parts),
    folders as (select page_id, i, case when i > 0 then p[i + 1 : len(p) - 1] end as f from placed)
"""


def paths(spark, folder):
    return table(spark, folder, "pages").withColumn("path", F.replace("url", F.lit("."), F.lit("/")))


@proof(PATH_CTE + """
    select page_id, case when len(f) > 1 then array_to_string(f, '.') when f is not null then '' end as package from folders
""")
def package_from_path(spark, folder):
    return paths(spark, folder).select("page_id", X.package_from_path(F.col("path"), "example").alias("package"))


@proof(PATH_CTE + """
    select page_id,
        array_to_string(list_concat(['build', 'generated_tests', 'site', 'execution'], f), '/') as execution_filepath,
        array_to_string(list_concat(['build', 'generated_tests', 'site', 'passed'], f), '/') as passed_filepath,
        array_to_string(list_concat(['build', 'generated_tests', 'site', 'compile_error'], f), '/') as compile_error_filepath,
        array_to_string(list_concat(['build', 'generated_tests', 'site', 'execution_error'], f), '/') as execution_error_filepath,
        array_to_string(list_concat(['build', 'compiled_tests', 'site'], f), '/') as compile_filepath,
        array_to_string(list_concat(['build', 'prompts', 'site'], f), '/') as prompt_path
    from folders
""")
def target_paths(spark, folder):
    made = X.target_paths(F.col("path"), F.lit("site"), "example")
    return paths(spark, folder).select("page_id", made.alias("t")).select("page_id", "t.*")


FIRST_WORD = "[x for x in string_split(replace(text, chr(10), ' '), ' ') if x <> ''][1]"


@proof("select doc_id, source || 'Test_Method_' || doc_id || '_Run_night-7' as name, true as own_id from documents")
def run_ids(spark, folder):
    """A given run id stands in every name; without one, the id is the session's time."""
    given, own = X.run_id(spark, "night-7"), X.run_id(spark)
    return table(spark, folder, "documents").select(
        "doc_id", X.unique_class_name(F.col("source"), F.col("doc_id"), given).alias("name"), F.lit(own).rlike("^[0-9]{8}_[0-9]{6}$").alias("own_id"))


@proof(f"""
    with named as (select doc_id, text, {FIRST_WORD} as w from documents)
    select doc_id, w as old_name, md5(replace('/* class Not */ public class ' || w || ' {{' || chr(10) || text || chr(10) || '}}',
                           w, w || 'Test_Method_' || doc_id || '_Run_r1')) as unit
    from named
""")
def unique_name(spark, folder):
    word = F.get(F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda x: x != ""), 0)
    docs = table(spark, folder, "documents").withColumn("w", word)
    unit = F.concat(F.lit("/* class Not */ public class "), "w", F.lit(" {\n"), "text", F.lit("\n}"))
    new_name = X.unique_class_name(F.col("w"), F.col("doc_id"), "r1")
    return docs.withColumn("unit", unit).select(
        "doc_id", X.first_class_name(F.col("unit")).alias("old_name"), F.md5(X.rename_class(F.col("unit"), new_name)).alias("unit"))


_PROMPT = template_sql(COMPILE_REPAIR, {"error_message": "role", "method_text": "text"})


@proof(f"""
    select conv_id, turn, case when {tokens_sql(_PROMPT)} < 160 then md5({_PROMPT}) else '' end as prompt from conversations
""", name="repair_prompt")
def repair_prompts(spark, folder):
    prompt = repair_prompt(F.col("text"), F.col("role"), budget=160)
    made = table(spark, folder, "conversations").withColumn("p", prompt)
    return made.select("conv_id", "turn", F.when(F.col("p") != "", F.md5("p")).otherwise("").alias("prompt"))


@proof("""
    select event_id, 'k' || user_id as name, coalesce(case when event_type <> 'click' then event_type end, 'primitive_type') as kind,
           cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) as k
    from events
""")
def declarator(spark, folder):
    text = F.concat(F.lit("\tk"), "user_id", F.lit(" = "), "event_type", F.lit(" = x"))
    kind = F.coalesce(F.when(F.col("event_type") != "click", F.col("event_type")), F.lit("primitive_type"))
    return table(spark, folder, "events").select(
        "event_id", X.declarator_name(text).alias("name"), kind.alias("kind"),
        F.from_json("props", "k bigint")["k"].alias("k"))


@proof("""
    select event_id, case when event_type = 'error' then props else event_type end as compiled,
           case when event_type = 'view' then props else event_type end as ran,
           case when value > 50 then 1 else 0 end as code, case when value > 50 then 'Timeout' else event_type end as output
    from events
""")
def pick_output(spark, folder):
    code = F.when(F.col("event_type") == "error", 1).otherwise(0)
    stdout = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    result = F.struct(F.lit(0).alias("code"), F.col("event_type").alias("output"))
    late = X.or_timeout(result, F.col("value") > 50)
    return table(spark, folder, "events").select(
        "event_id", X.compile_output(code, F.col("event_type"), F.col("props")).alias("compiled"),
        X.run_output(stdout, F.col("props")).alias("ran"), late["code"].alias("code"), late["output"].alias("output"))


@proof(r"""
    select conv_id, turn, md5(replace(replace(text, chr(10), ' '), chr(13), '')) as info,
           'Compilation Error Round ' || turn as event
    from conversations
""")
def log_fields(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.md5(X.clean_info(F.col("text"))).alias("info"),
        X.event_name("Compilation Error Round {n}", F.col("turn")).alias("event"))


@proof(f"select doc_id, cast({tokens_sql('text')} as integer) as tokens, {tokens_sql('text')} < 300 as fits from documents",
       name="token_count")
def token_counts(spark, folder):
    counted = table(spark, folder, "documents").withColumn("tokens", token_count(F.col("text")))
    return counted.select("doc_id", "tokens", fits_budget(F.col("tokens"), 300).alias("fits"))


@proof(f"""
    with c as (select doc_id, len(string_split(text, chr(10))) as a, {tokens_sql('text')} as b,
                      cast(n_chars // 10 as bigint) as c, {tokens_sql("replace(text, ',', ' , ')")} as d from documents)
    select doc_id, case when a >= 90 then 0 when b >= 90 then 1 when c >= 90 then 2 when d >= 90 then 3 else 4 end as level from c
""", name="choose_level")
def chosen_level(spark, folder):
    text = F.col("text")
    counts = [F.size(F.split(text, "\n", -1)), token_count(text), F.expr("n_chars div 10"),
              token_count(F.replace(text, F.lit(","), F.lit(" , ")))]
    return table(spark, folder, "documents").select("doc_id", choose_level(counts, 90).alias("level"))
