"""Round trips: what is written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from unitloom.proofs.registry import proof, table
from unitloom.session import shared_folder
from unitloom.sources.events import read_events, write_events
from unitloom.sources.files import project_sources, with_project
from unitloom.sources.listing import write_files
from unitloom.sources.records import CLASS_RECORD, METHOD_RECORD, read_facts_json, write_facts_json
from unitloom.sources.tables import FACT_TABLES, read_artifacts, read_fact_tables, route_by_outcome, write_artifacts, write_fact_tables


def place(spark) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


@proof(r"""
    select o_orderpriority as project_name, o_orderkey as method_id, case when o_orderstatus = 'F' then 'Passed' else 'Failed' end as event,
           case when o_orderstatus = 'F' then 0 else 1 end as result_code,
           'say "' || o_orderstatus || '", ' || o_custkey || '\' || o_orderpriority as add_info from orders
""")
def event_log(spark, folder):
    done = F.col("o_orderstatus") == "F"
    info = F.concat(F.lit('say "'), "o_orderstatus", F.lit('", '), F.col("o_custkey").cast("string"), F.lit("\\"), "o_orderpriority")
    path = place(spark)
    write_events(table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("project_name"), F.col("o_orderkey").cast("bigint").alias("method_id"),
        F.when(done, "Passed").otherwise("Failed").alias("event"), F.when(done, 0).otherwise(1).alias("result_code"), info.alias("add_info")), path)
    return read_events(spark, path)


def _tables(spark, folder, edges: bool):
    units = table(spark, folder, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("project"), F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name"))
    made = {name: spark.createDataFrame([], schema) for name, schema in FACT_TABLES.items()}
    made["projects"] = units.select("project").distinct()
    made["methods"] = units.select(
        "project", F.lit("p").alias("package"), F.col("id").alias("method_id"), F.col("name").alias("method_identifier"),
        F.lit("C").alias("class_identifier"), F.concat("name", F.lit("()")).alias("full_text"), F.lit(0).alias("ord"))
    if edges:
        made["related_methods"] = units.select("project", F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit(0).alias("ord"))
    return made


@proof("""
    select 'n' || c_nationkey as project, c_custkey as method_id, c_name as method_identifier, c_name || '()' as full_text,
           case when c_nationkey % 2 = 0 then c_custkey + 1 end as target_id from customer
""")
def replaced_projects(spark, folder):
    """Projects are written with edges; those of odd nations are then replaced without any."""
    path, later = place(spark), {name: t.where(~F.col("project").rlike("[02468]$")) for name, t in _tables(spark, folder, False).items()}
    write_fact_tables(_tables(spark, folder, True), path)
    write_fact_tables(later, path)
    tables = read_fact_tables(spark, path)
    edges = tables["related_methods"].select("project", F.col("source_id").alias("method_id"), "target_id")
    return tables["methods"].join(edges, ["project", "method_id"], "left").select("project", "method_id", "method_identifier", "full_text", "target_id")


@proof("select c_name as method_identifier, c_custkey as method_id from customer where c_nationkey = 7")
def one_project(spark, folder):
    path = place(spark)
    write_fact_tables(_tables(spark, folder, False), path)
    return read_fact_tables(spark, path, "n7")["methods"].select("method_identifier", "method_id")


@proof("""
    select 'n' || s_nationkey as project, 'p' || s_suppkey % 3 as package, 'f' || s_suppkey as filepath, list_value(s_name, s_name || 'b') as names
    from supplier
""")
def json_records(spark, folder):
    """Classes of one name in many files; each keeps its own methods."""
    rows = table(spark, folder, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("project"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    package = F.concat(F.lit("p"), (F.col("id") % 3).cast("string"))
    unit = F.from_json(F.to_json(F.struct(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("filepath"), F.lit("C").alias("class_identifier"), package.alias("package"))), CLASS_RECORD)
    methods = F.from_json(F.to_json(F.array(
        F.struct(F.col("name").alias("method_identifier")), F.struct(F.concat("name", F.lit("b")).alias("method_identifier")))), f"array<{METHOD_RECORD}>")
    path = place(spark)
    write_facts_json(rows.select("project", unit.alias("class_record"), methods.alias("methods")), path)
    return read_facts_json(spark, path).select(
        "project", "class_record.package", "class_record.filepath", F.transform("methods", lambda m: m["method_identifier"]).alias("names"))


@proof("select source as project, lang as package, doc_id as method_id, text as prompt from documents")
def artifacts(spark, folder):
    path = place(spark)
    write_artifacts(table(spark, folder, "documents").select(
        F.col("source").alias("project"), F.col("lang").alias("package"), F.col("doc_id").alias("method_id"), F.col("text").alias("prompt")), path)
    return spark.read.parquet(path).select("project", "package", "method_id", "prompt")


@proof("select o_orderkey as method_id, case o_orderstatus when 'F' then 'passed' when 'O' then 'compile_error' else 'other_error' end as outcome from orders")
def outcomes_on_disk(spark, folder):
    path, status = place(spark), F.col("o_orderstatus")
    outcome = F.when(status == "F", "passed").when(status == "O", "compile_error").otherwise("other_error")
    route_by_outcome(table(spark, folder, "orders").select(F.col("o_orderkey").alias("method_id"), outcome.alias("outcome")), path)
    return spark.read.parquet(path).select("method_id", "outcome")


@proof("""
    select source as project, md5(coalesce(text, '')) as content, source || '/_' || lang || '/.hidden/' || (doc_id % 7) || '/_' || doc_id || '.java' as path
    from documents where doc_id % 4 <> 1 and doc_id % 5 <> 2
""")
def scanned_files(spark, folder):
    """Documents as files, some in folders or with names that are no sources, written and scanned."""
    root, doc = place(spark), F.col("doc_id")
    named = F.concat(F.when(doc % 4 == 1, "Test").otherwise("_"), "doc_id", F.lit(".java"))
    below = F.when(doc % 5 == 2, "test").otherwise((doc % 7).cast("string"))
    path = F.concat_ws("/", "source", F.concat(F.lit("_"), "lang"), F.lit(".hidden"), below, named)
    write_files(table(spark, folder, "documents").select(path.alias("path"), F.col("text").alias("content")), root)
    return project_sources(spark, root).select("project", "path", F.md5("content").alias("content"))


@proof("""
    select source as project, source || '/' || lang || '/' || doc_id || '.java' as path from documents where doc_id % 3 <> 0 and source <> ''
""")
def project_of_path(spark, folder):
    """Some paths lie beside the projects, and have none."""
    below = F.concat_ws("/", "lang", F.concat("doc_id", F.lit(".java")))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat("doc_id", F.lit(".java"))).otherwise(F.concat_ws("/", "source", below))
    return with_project(table(spark, folder, "documents").select(path.alias("path"))).select("project", "path")


@proof("""
    select conv_id as method_id, cast(turn as integer) as ord, role as event, cast(length(text) % 3 as integer) as result_code, md5(text) as add_info
    from conversations
""")
def ordered_events(spark, folder):
    """Several events of an item, logged in any order, keep theirs."""
    turns = table(spark, folder, "conversations")
    path = place(spark)
    write_events(turns.select(
        F.lit("p").alias("project_name"), F.col("conv_id").cast("bigint").alias("method_id"), F.col("turn").cast("int").alias("ord"), F.col("role").alias("event"),
        (F.length("text") % 3).alias("result_code"), F.md5("text").alias("add_info")).repartition(7, "event"), path)
    return read_events(spark, path, ordered=True).select("method_id", "ord", "event", "result_code", "add_info")


@proof("select doc_id as method_id, md5(text) as prompt from documents where source = 'src3' and lang = 'en'")
def one_package(spark, folder):
    """Artifacts of one package, read by filters that reach the files."""
    path = place(spark)
    write_artifacts(table(spark, folder, "documents").select(
        F.col("source").alias("project"), F.col("lang").alias("package"), F.col("doc_id").alias("method_id"), F.col("text").alias("prompt")), path, clustered=True)
    return read_artifacts(spark, path, "src3", "en").select("method_id", F.md5("prompt").alias("prompt"))
