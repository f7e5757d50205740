"""Facts from Java-shaped node tables."""

import pytest

from tests.trees import (
    N, block, call, cls, constructor, field, ident, load, local, method, new, obj, param, params, program, stmt,
    this_field, typ, word,
)
from unitloom.plans import extract as X


def int_type(field=None):
    return N("integral_type", "int", field=field)


def main_tree():
    """One file with every branch of the fact rules."""
    a = cls(
        "Alpha",
        field(typ("Repo", "type"), ident("repo"), " = ", new("Repo")),
        field(int_type("type"), ident("count")),
        field(typ("Grüße", "type"), ident("gruß")),
        constructor("Alpha", params(param(typ("Repo", "type"), "r"), param(int_type("type"), "n")),
                    block(stmt(new("Helper")), kind="constructor_body")),
        N("block_comment", "/* adds ü */"),
        method(typ("Result", "type"), "run",
               params(param(typ("Task", "type"), "task"), param(N("generic_type", typ("List"), "<T>", field="type"), "xs"),
                      param(typ("Final", "type"), "f", N("modifiers", "final"), " ")),
               block(
                   local(typ("Box", "type"), "box", new("Box")),
                   local(typ("Early", "type"), "twice"), local(typ("Late", "type"), "twice"),
                   stmt(call("open", obj("box"))), stmt(call("go", obj("task"), ident("box"), ident("zzz"), ident("twice"))),
                   stmt(call("save", this_field("repo"))), stmt(call("bare", obj("repo"))),
                   stmt(call("own")), stmt(call("of", obj("List"))), stmt(call("f", obj("f"))),
                   stmt(call("outer", call("inner", obj("twice")).__class__(
                       "method_invocation", obj("twice"), word("."), ident("inner", "name"),
                       N("argument_list", "()", field="arguments"), field="object"))),
               ), modifiers="public"),
        N("line_comment", "// not attached"),
        method(int_type("type"), "abs", params(), modifiers="abstract"),
        field(typ("Tail", "type"), ident("tail")),
        N("comment", "// c"),
        N("enum_declaration", "enum E {}"),
        method(int_type("type"), "after", params(), block(stmt(new("Helper")), stmt(new("Helper")))),
        cls("Nested", method(int_type("type"), "hidden", params(), block(stmt(call("no"))))),
        modifiers="public", interfaces="implements Runnable",
    )
    return program(N("package_declaration", "package a.b;"), N("import_declaration", "import x.Y;"),
                   N("import_declaration", "import x.Z;"), N("interface_declaration", "interface I {}"), a)


@pytest.fixture(scope="module")
def facts(spark):
    plain = program(cls("Plain", method(int_type("type"), "m", params(), block(stmt(call("run"))))))
    tested = program(cls("Checked", N("marker_annotation", "@Test"), method(int_type("type"), "t", params(), block())))
    sources, nodes = load(spark, [
        ("p1", "p1/src/main/java/a/b/Alpha.java", main_tree()), ("p1", "p1/src/main/java/Plain.java", plain),
        ("p1", "p1/src/main/java/Checked.java", tested),
    ])
    nodes = nodes.cache()
    ready = X.prepare_sources(sources)
    return sources, nodes, ready, X.annotate(nodes, ready).persist()


def rows(df, *columns):
    return [tuple(row) for row in df.select(*columns).collect()]


def test_units(facts):
    sources, nodes, ready, placed = facts
    found = {row.class_identifier: row for row in X.unit_facts(placed, nodes, ready).collect()}
    assert set(found) == {"Alpha", "Plain"}  # neither nested nor marked ones
    alpha, plain = found["Alpha"], found["Plain"]
    assert (alpha.modifier, alpha.super_interfaces) == ("public", "implements Runnable")
    assert alpha.imports == "import x.Y;\nimport x.Z;" and alpha.package == "package a.b;"
    assert alpha.full_text.startswith("public class Alpha") and alpha.full_text.endswith("}")
    assert alpha.header.endswith("Tail tail;") and "abs" in alpha.header  # runs to a field behind methods
    assert (plain.header, plain.modifier, plain.super_interfaces, plain.imports, plain.package) == ("", "", "", "", "")


def test_fields(facts):
    _, _, ready, placed = facts
    found = rows(X.field_facts(placed).orderBy("ord"), "variable_identifier", "variable_type")
    assert found == [("repo", "Repo"), ("count", "primitive_type"), ("gruß", "Grüße"), ("tail", "Tail")]


def test_members(facts):
    _, _, ready, placed = facts
    found = {row.identifier: row.full_text for row in X.member_facts(placed).where("file_id = 1").collect()}
    assert set(found) == {"run", "abs", "after"}
    assert found["run"].startswith("/* adds ü */\npublic Result run(")
    assert found["abs"].startswith("abstract int abs")  # a line_comment is none of the two kinds
    assert found["after"].startswith("int after")  # the comment stands before the enum


def test_constructors(facts):
    _, _, ready, placed = facts
    found = rows(X.constructor_facts(placed), "identifier", "parameter_types", "related_classes")
    assert found == [("Alpha", ["Repo"], ["Helper"])]


def test_parameters(facts):
    _, _, ready, placed = facts
    found = rows(X.parameter_facts(placed).orderBy("member_id", "ord"), "parameter_name", "parameter_type")
    assert found == [("r", "Repo"), ("task", "Task")]  # no primitive, generic or final ones


def test_created(facts):
    _, _, ready, placed = facts
    found = rows(X.created_types(placed).orderBy("ord"), "created_type")
    assert [kind for kind, in found] == ["Helper", "Box", "Helper", "Helper"]


def test_locals(facts):
    _, _, ready, placed = facts
    assert sorted(rows(X.local_facts(placed), "name", "variable_type")) == [("box", "Box"), ("twice", "Late")]


def test_calls(facts):
    _, _, ready, placed = facts
    found = rows(X.call_facts(placed).where("file_id = 1").orderBy("ord"), "method_name", "method_class", "argument_types")
    assert found == [
        ("open", "Box", []), ("go", "Task", ["Box", "Late"]), ("save", "Repo", []), ("bare", "repo", []),
        ("own", "Alpha", []), ("of", "List", []), ("f", "f", []), ("outer", "twice.inner()", []), ("inner", "Late", []),
    ]
    other = rows(X.call_facts(placed).where("file_id = 2"), "method_name", "method_class")
    assert other == [("run", "Plain")]


def test_records(facts):
    sources, nodes, _, placed = facts
    found = {row.class_record.class_identifier: row for row in X.class_records(nodes, sources, annotated=placed).collect()}
    assert set(found) == {"Alpha", "Plain"}
    alpha = found["Alpha"]
    assert [m.method_identifier for m in alpha.methods] == ["run", "abs", "after"]
    run = alpha.methods[0]
    assert run.method_parameter_types == {"task": "Task"} and run.related_classes == ["Box"]
    assert run.related_methods[1].argument_types == ["Box", "Late"] and alpha.methods[1].related_methods == []
    assert alpha.class_record.class_methods[0].method_parameter_types == ["Task"]
    assert found["Plain"].class_record.class_constructors == []


def test_one_shuffle_of_nodes(facts, capsys):
    _, _, ready, placed = facts
    X.member_facts(placed).explain()
    plan = capsys.readouterr().out
    assert plan.count("NestedLoop") == 0 and plan.count("CartesianProduct") == 0


def test_records_shuffle_nodes_once(spark, facts):
    """Nodes and sources are placed by file; no later step, and no text of a node, is shuffled."""
    sources, nodes, _, _ = facts
    stored = [frame.sparkSession.createDataFrame(frame.collect(), frame.schema) for frame in (sources, nodes)]
    made = X.class_records(stored[1], stored[0])
    plan = made._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("hashpartitioning(file_id" in line for line in exchanges)
    # one of the nodes, and one of the sources at each of the two joins that cut texts
    assert len(exchanges) == 3 and "Exchange SinglePartition" not in plan
    found = {row.class_record.class_identifier: row for row in made.collect()}
    assert [m.method_identifier for m in found["Alpha"].methods] == ["run", "abs", "after"]
    assert found["Alpha"].methods[0].method_full_text.startswith("/* adds ü */\npublic Result run(")
    assert found["Alpha"].class_record.imports == "import x.Y;\nimport x.Z;"


def test_call_facts_shuffle_once_at_most(facts):
    _, _, _, placed = facts
    plan = X.call_facts(placed)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange hashpartitioning") <= 1


def test_things_sort_no_nodes(spark, facts):
    """Nodes go packed through one shuffle; no window or sort holds a row per node."""
    sources, nodes, _, _ = facts
    stored = [frame.sparkSession.createDataFrame(frame.collect(), frame.schema) for frame in (sources, nodes)]
    plan = X.things(stored[1], X.prepare_sources(stored[0]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_order_of_nodes_does_not_matter(spark, facts):
    """Nodes of a file may lie anywhere in the table, in any order and in many batches."""
    sources, nodes, ready, placed = facts
    spread = nodes.repartition(7, "node_id").orderBy("type", "start_byte")
    again = X.annotate(spread, ready)
    assert sorted(map(str, again.collect())) == sorted(map(str, placed.collect()))


def test_files_given_twice_and_without_id(spark, facts):
    """A content given twice gives its things twice; files without an id or a content give none."""
    from pyspark.sql import functions as F

    sources, nodes, ready, _ = facts
    twice = ready.where("file_id = 2").unionByName(ready.where("file_id in (1, 2)"))
    lost = nodes.where("file_id = 1").withColumn("file_id", F.lit(None).cast("bigint"))
    found = X.things(nodes.unionByName(lost), twice).groupBy("file_id").count().collect()
    once = {row["file_id"]: row["count"] for row in X.things(nodes, ready).groupBy("file_id").count().collect()}
    assert {row["file_id"]: row["count"] for row in found} == {1: once[1], 2: 2 * once[2]}


def test_lines_are_counted_between_members(spark):
    """Line numbers take each text once, however many members a file has."""
    from unitloom.operators.nodes import nodes_from
    from unitloom.proofs import facts as P

    texts = [(1, "p", "a", "\n".join(["Unit"] + [f"T m{i} A a" for i in range(50)])), (2, "p", "b", "\n\nU x y z\nü\nT m A a")]
    sources = spark.createDataFrame(texts, "file_id bigint, project string, path string, content string")
    nodes, ready = nodes_from(sources, P.line_parser()), X.prepare_sources(sources)
    members = nodes.where("type = 'method_declaration'").select("file_id", nodes.node_id.alias("member_id"))
    made = P._with_line(members, nodes, ready)
    assert sorted(tuple(row) for row in made.select("file_id", "line").collect()) == [(1, i) for i in range(2, 52)] + [(2, 3), (2, 5)]
    assert "lag(" in made._jdf.queryExecution().executedPlan().toString()
    # a file given twice has each member, and its line, once for each tree and content
    again = P._with_line(members, nodes.unionByName(nodes), ready.unionByName(ready)).where("file_id = 2").select("line").collect()
    assert sorted(row.line for row in again) == [3] * 4 + [5] * 4


def test_things_of_kinds_that_a_fact_reads_are_all_it_reads(spark):
    sources, nodes = load(spark, [("p1", "p1/src/main/java/a/b/Alpha.java", main_tree())])
    ready = X.prepare_sources(sources)
    everything = X.annotate(nodes, ready).cache()
    for fact, kinds in X.READS.items():
        some = X.annotate(nodes, ready, kinds)
        assert {row.kind for row in some.collect()} <= {X.CODES[kind] for kind in kinds}
        if fact == "unit_facts":
            found, wanted = (X.unit_facts(rows, None, ready, "no marker") for rows in (some, everything))
        else:
            found, wanted = (getattr(X, fact)(rows) for rows in (some, everything))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect())), fact
        assert wanted.count()
    everything.unpersist()


def test_nodes_that_are_sorted_lie_in_memory_compressed(spark):
    sources, nodes = load(spark, [("p1", "p1/src/main/java/a/b/Alpha.java", program(cls("A", *[
        method(typ("T", "type"), f"m{i}", params(), block(stmt(new("Helper")))) for i in range(300)])))])
    held = X._by_file(nodes, X.prepare_sources(sources)).where("nodes IS NOT NULL").selectExpr("sum(length(nodes))").first()[0]
    assert held < 8 * nodes.where("is_named").count()  # eight numbers of four bytes each


def test_class_names_hold_no_table_in_one_task(spark):
    def parser():
        return lambda text: [(0, 2, None, 0, "program", True, None, 0, len(text)), (1, 2, 0, 0, "class_declaration", True, None, 0, len(text)),
                             (2, 2, 1, 0, "identifier", True, "name", 0, len(text))]

    texts = spark.createDataFrame([(1, "A"), (2, "B")], "file_id long, content string")
    names = X.class_names(texts, parser)
    assert sorted(map(tuple, names.collect())) == [(1, "A"), (2, "B")]
    assert "BroadcastHashJoin" not in names._jdf.queryExecution().executedPlan().toString()
