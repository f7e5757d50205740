"""Files, fact records, fact tables, events and routed results on disk."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from unitloom.plans import load
from unitloom.sources import events, files, listing, records, tables

CONTENT = "class A {\n  // ü\n}\n"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("pro jects")
    for path in ["p1/src/main/java/a/b/A.java", "p1/src/main/java/a/ATest.java", "p1/src/test/java/a/B.java",
                 "p1/src/latest/java/a/D.java", "p2/readme.md", "p 3+x/E.java", "Loose.java"]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(CONTENT)
    return str(root)


def test_scan(spark, corpus):
    found = files.project_sources(spark, corpus).collect()
    assert {(r.project, r.path) for r in found} == {
        ("p1", "p1/src/main/java/a/b/A.java"), ("p1", "p1/src/latest/java/a/D.java"), ("p 3+x", "p 3+x/E.java")}
    assert {r.content for r in found} == {CONTENT}
    counts = {r.project: r.n for r in files.count_by_group(files.project_sources(spark, corpus), "project").collect()}
    assert counts == {"p1": 2, "p 3+x": 1}


def test_every_name_is_listed(spark, tmp_path):
    """Names that Spark's reader hides, folders passed on over several rounds, and files of any bytes."""
    wanted = {}
    for i in range(40):
        for path in (f"p{i % 3}/_u/.h/d{i}/A{i}.java", f"p{i % 3}/_u/.h/d{i}/e/.B{i}.java", f"p{i % 3}/_C{i}.java"):
            (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / path).write_text(f"{path} ü" * (i % 4))
            wanted[path] = f"{path} ü" * (i % 4)
    (tmp_path / "p1/notes.txt").write_text("no")
    (tmp_path / "empty/below").mkdir(parents=True)
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        found = listing.list_files(spark, root, "*.java", folders_per_task=7)
        assert {(r.path, r.size) for r in found.collect()} == {(path, len(text.encode())) for path, text in wanted.items()}
    rows = listing.read_files(found.withColumn("mark", F.lit(1)), str(tmp_path), bytes_per_task=100).collect()
    assert {r.path: r.content for r in rows} == wanted and {r.mark for r in rows} == {1}
    assert listing.list_files(spark, str(tmp_path / "empty")).count() == 0
    assert listing.read_files(listing.list_files(spark, str(tmp_path / "empty")), str(tmp_path)).count() == 0


def test_files_are_written_whole(spark, tmp_path):
    rows = [("a/_b/.c", "x" * 100_000), ("a/d e+%20.txt", "ü"), ("f", None)]
    df = spark.createDataFrame(rows, "path string, content string")
    for _ in range(2):
        assert listing.write_files(df, f"{tmp_path}/out") == 3
    assert {(r.path, r.content) for r in files.scan_sources(spark, f"{tmp_path}/out", "*").collect()} == {(p, c or "") for p, c in rows}


def test_scan_failures(spark, corpus):
    with pytest.raises(Exception):
        files.scan_sources(spark, corpus + "/none").count()
    everything = files.with_project(files.scan_sources(spark, corpus, "*"))
    with pytest.raises(ValueError, match="p2"):
        files.require_groups(everything, files.project_sources(spark, corpus), "project")
    with pytest.raises(ValueError, match="no project"):
        files.require_groups(everything.where("false"), everything, "project")
    files.require_groups(everything.where("project = 'p1'"), everything, "project")


def record(name, package="package a;", path=None, methods=()):
    unit = dict(filepath=path or f"p/java/{name}.java", class_identifier=name, class_modifier="", class_super_interfaces="",
                class_constructors=[], class_header="", class_full_text=f"class {name}", class_methods=[],
                class_variable_declarations=[{"variable_identifier": "v", "variable_type": "T"}], imports="", package=package)
    made = [dict(method_identifier=m, method_parameter_types=p, method_full_text=f"{m}()", class_identifier=name,
                 filepath=unit["filepath"], related_classes=[], related_methods=[
                     dict(method_name=n, method_class=c, argument_types=[]) for n, c in calls]) for m, p, calls in methods]
    return unit, made


def record_rows(spark, items):
    schema = f"project string, class_record {records.CLASS_RECORD}, methods array<{records.METHOD_RECORD}>"
    lines = [json.dumps({"project": project, "class_record": unit, "methods": methods}) for project, (unit, methods) in items]
    text = spark.createDataFrame([(line,) for line in lines], "line string")
    return text.select(F.from_json("line", schema).alias("r")).select("r.*")


def test_json_records(spark, tmp_path):
    made = record_rows(spark, [("p1", record("A", methods=[("m", {"a": "B"}, [("m", "A")])])), ("p2", record("B"))])
    records.write_facts_json(made, str(tmp_path))
    back = {r.project: r for r in records.read_facts_json(spark, str(tmp_path)).collect()}
    assert back["p1"].methods[0].method_parameter_types == {"a": "B"} and back["p2"].methods == []
    assert back["p1"].class_record.class_variable_declarations[0].variable_type == "T"
    assert sorted(map(str, back.values())) == sorted(map(str, made.collect()))


def test_record_files(spark, tmp_path):
    """A file of two classes is stored under the second; a class without methods file is dropped."""
    a, a_methods = record("A", methods=[("ma", {}, [])])
    b, b_methods = record("B", methods=[("mb", {}, [])])
    c, _ = record("C")
    for path, value in [("p/A/methods.json", a_methods), ("p/B/class.json", [a, b]), ("p/B/methods.json", b_methods),
                        ("p/C/class.json", [c])]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(value))
    found = {r.class_record.class_identifier: [m.method_identifier for m in r.methods]
             for r in records.read_record_files(spark, str(tmp_path)).collect()}
    assert found == {"A": ["ma"], "B": ["mb"]}


def fact_tables(spark):
    from unitloom.plans.load import to_fact_tables

    calls = [("run", "A"), ("run", "A"), ("go", "A"), ("none", "A"), ("run", "Gone")]
    items = [
        ("p1", record("A", methods=[("run", {"x": "B", "y": "Gone"}, calls), ("run", {"z": "A"}, []), ("go", {}, [("run", "A")])])),
        ("p1", record("B", package="package b;", methods=[("only", {}, [])])),
        ("p1", record("B", package="package c;", path="p/java/c/B.java", methods=[("only", {}, [])])),
        ("p2", record("A", path="p/java/1/A.java", methods=[("old", {}, [])])),
        ("p2", record("A", path="p/java/2/A.java", methods=[("new", {}, [])])),
    ]
    return to_fact_tables(record_rows(spark, items))


def test_load(spark):
    made = fact_tables(spark)
    methods = {(r.project, r.method_id): (r.class_identifier, r.method_identifier) for r in made["methods"].collect()}
    assert methods == {("p1", 1): ("A", "run"), ("p1", 2): ("A", "run"), ("p1", 3): ("A", "go"), ("p1", 4): ("B", "only"),
                       ("p1", 5): ("B", "only"), ("p2", 1): ("A", "new")}
    edges = sorted((r.source_id, r.target_id, r.ord) for r in made["related_methods"].collect())
    assert edges == [(1, 1, 0), (1, 1, 1), (1, 3, 2), (3, 1, 0)]  # self-calls and repeats kept, unknown ones dropped
    links = sorted((r.method_id, r.class_identifier, r.package) for r in made["related_classes"].collect())
    assert links == [(1, "B", "package b;"), (2, "A", "package a;")]
    parameters = sorted((r.project, r.method_id, r.parameter_name) for r in made["method_parameters"].collect())
    assert parameters == [("p1", 1, "x"), ("p1", 1, "y"), ("p1", 2, "z")]  # overloads keep their own


def test_simple_names(spark):
    from unitloom.plans.load import to_fact_tables

    items = [("p", record("A", package="package b;", path="p/1.java")), ("p", record("A", package="package a;", path="p/2.java"))]
    rows = record_rows(spark, items)
    assert to_fact_tables(rows)["classes"].count() == 2
    assert [r.filepath for r in to_fact_tables(rows, simple_names=True)["classes"].collect()] == ["p/2.java"]


def test_fact_tables_on_disk(spark, tmp_path):
    made = fact_tables(spark)
    tables.write_fact_tables(made, str(tmp_path))
    one = {name: t.where("project = 'p2'") for name, t in made.items()}
    tables.write_fact_tables(one, str(tmp_path))  # replaces p2, leaves p1
    back = tables.read_fact_tables(spark, str(tmp_path))
    assert back["methods"].count() == 6 and {r.project for r in back["projects"].collect()} == {"p1", "p2"}
    single = tables.read_fact_tables(spark, str(tmp_path), "p2")["methods"]
    assert single.count() == 1
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(project" in plan


ROWS = [("p", 1, "Other Error", 1, 'a "quoted"; \\ back\nline'), ("p", 1, "Timeout Error", 1, ""), ("q", 2, "x", 0, "\\\\two")]


def test_events(spark, tmp_path):
    made = spark.createDataFrame(ROWS, events.EVENT_SCHEMA)
    path = str(tmp_path / "log")
    events.write_events(made.limit(2), path)
    events.write_events(made.where("project_name = 'q'"), path)
    back = sorted(tuple(r) for r in events.read_events(spark, path).collect())
    assert back == sorted((*r[:4], r[4].replace("\n", " ")) for r in ROWS)


def test_events_of_a_plain_writer(spark, tmp_path):
    """Header separated by commas, rows by semicolons, backslashes escaped."""
    path = tmp_path / "plain.csv"
    with open(path, "w", newline="") as out:
        csv.writer(out).writerow(["project_name", "method_id", "event", "result_code", "add_info"])
        writer = csv.writer(out, delimiter=";", escapechar="\\")
        for row in ROWS:
            writer.writerow([*row[:4], row[4].replace("\n", " ")])
    back = sorted(tuple(r) for r in events.read_events(spark, str(path)).collect())
    assert back == sorted((*r[:4], r[4].replace("\n", " ")) for r in ROWS)


def test_routes(spark, tmp_path):
    items = spark.createDataFrame([("p", "a.b", 1, "passed"), ("p", "a.c", 2, "compile_error")],
                                  "project string, package string, method_id int, outcome string")
    tables.route_by_outcome(items, str(tmp_path / "by_outcome"))
    tables.write_artifacts(items, str(tmp_path / "artifacts"))
    assert (tmp_path / "by_outcome" / "outcome=passed").is_dir()
    assert spark.read.parquet(str(tmp_path / "by_outcome")).where("outcome = 'compile_error'").first().method_id == 2
    assert (tmp_path / "artifacts" / "project=p" / "package=a.b").is_dir()


def test_artifacts_are_clustered(spark, tmp_path):
    """A project is one folder; files hold runs of packages, so a reader of one package can pass over the others."""
    rows = [("p", f"k{i % 50:02d}", i, "x" * 50) for i in range(4000)] + [("p", "hot", 10_000 + i, "y" * 50) for i in range(4000)] + [("q", None, 1, "z")]
    df = spark.createDataFrame(rows, "project string, package string, method_id int, prompt string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small files, as large ones would be
    try:
        tables.write_artifacts(df, str(tmp_path / "a"), clustered=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = spark.read.parquet(str(tmp_path / "a"))
    spans = found.where("project = 'p'").groupBy(F.col("_metadata.file_path")).agg(F.min("package").alias("first"), F.max("package").alias("last")).collect()
    assert len(spans) > 1 and sum(r["first"] <= "k07" <= r["last"] for r in spans) == 1
    assert sum(r["first"] <= "hot" <= r["last"] for r in spans) > 1  # a large package has several files
    one = tables.read_artifacts(spark, str(tmp_path / "a"), "p", "k07")
    assert one.count() == 80 and tables.read_artifacts(spark, str(tmp_path / "a")).count() == 8001
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(package,k07)" in plan and "PartitionFilters: [isnotnull(project" in plan


def test_several_parameters_keep_their_order(spark):
    """Methods with two to four parameters: order of parameters, of links to classes, and of calls."""
    named = {"run": {"c": "C", "a": "A", "b": "B"}, "go": {"z": "B", "y": "A"}, "all": {"d": "A", "c": "B", "b": "C", "a": "A"}}
    calls = [("go", "A"), ("none", "A"), ("run", "A"), ("go", "A")]
    items = [("p", record("A", methods=[(m, p, calls if m == "all" else []) for m, p in named.items()])), ("p", record("B")), ("p", record("C"))]
    made = load.to_fact_tables(record_rows(spark, items))
    methods = {r.method_id: r.method_identifier for r in made["methods"].collect()}
    assert [methods[i] for i in sorted(methods)] == list(named)
    parameters = made["method_parameters"].orderBy("method_id", "ord").collect()
    assert [(methods[r.method_id], r.parameter_name, r.parameter_type) for r in parameters] == [
        (m, name, kind) for m, p in named.items() for name, kind in p.items()]
    links = made["related_classes"].orderBy("method_id", "ord").collect()
    assert [(methods[r.method_id], r.ord, r.class_identifier) for r in links] == [
        (m, i, kind) for m, p in named.items() for i, kind in enumerate(p.values())]
    edges = made["related_methods"].orderBy("source_id", "ord").collect()
    assert [(methods[r.source_id], r.ord, methods[r.target_id]) for r in edges] == [("all", 0, "go"), ("all", 2, "run"), ("all", 3, "go")]


def test_a_load_shuffles_whole_methods_for_no_table_that_lists_their_parts(spark):
    """Records are chosen by their keys; methods, parameters and calls move what they hold, and that once."""
    import re

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        made = fact_tables(spark)
        for name in ("methods", "method_parameters", "related_methods", "related_classes", "classes"):
            made[name].count()
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            plan = made[name]._jdf.queryExecution().explainString(mode)
            moved = re.findall(r"\) Exchange[^\n]*\nInput \[\d+\]: ([^\n]*)", plan)
            assert moved and not [columns for columns in moved if re.search(r"\bmethods#", columns)]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
