"""Fact extraction over documents, read as programs of a small line language.

The parser below stands for a user's parser.  A document is one class named by its first
word.  A line of one word is an import, of two a comment, of three a field (type, name),
and a longer one a member: type, name, one parameter (type, name), then groups of six
words: a local variable (type, name), a call (receiver, name, argument) and a created
type.  A comma marks the odd cases: after a member's name a constructor, after a
parameter's type a generic type, after a receiver a field access, after a field's type a
primitive type; a dot after a receiver means there is none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from unitloom.operators.nodes import RISING, nodes_from
from unitloom.plans import extract, load
from unitloom.proofs.registry import proof, table
from unitloom.session import cut_lineage

MARKER = "ndst"


def line_parser():
    """Maker of the parser; nested, so that it travels to the workers by value."""
    def make():
        import re

        words = re.compile(rb"[^ ]+")
        COMMA, DOT = b",."

        def parse(text):
            data = text.encode()
            rows = []

            def open_node(parent, ord_, type, start, end, field=None):
                rows.append([len(rows), None, parent, ord_, type, True, field, start, end])
                return len(rows) - 1

            def close(node):
                rows[node][1] = len(rows) - 1

            def leaf(parent, ord_, type, start, end, field=None):
                rows.append((len(rows), len(rows), parent, ord_, type, True, field, start, end))

            def comma(span):
                return data[span[1] - 1:span[1]] == b","

            lines, at = [], 0
            for line in data.split(b"\n"):
                spans = [(at + m.start(), at + m.end()) for m in words.finditer(line)]
                if spans:
                    lines.append((at, at + len(line), spans))
                at += len(line) + 1

            root = open_node(None, 0, "program", 0, len(data))
            imports = [line for line in lines if len(line[2]) == 1]
            for ord_, (start, end, _) in enumerate(imports):
                leaf(root, ord_, "import_declaration", start, end)
            if lines:
                unit = open_node(root, len(imports), "class_declaration", 0, len(data))
                leaf(unit, 0, "identifier", *lines[0][2][0], "name")
                body = open_node(unit, 1, "class_body", 0, len(data), "body")
                kept = [line for line in lines if len(line[2]) > 1]
                for ord_, (start, end, spans) in enumerate(kept):
                    if len(spans) == 2:
                        leaf(body, ord_, "comment", start, end)
                    elif len(spans) == 3:
                        node = open_node(body, ord_, "field_declaration", start, end)
                        leaf(node, 0, "integral_type" if comma(spans[0]) else "type_identifier", *spans[0], "type")
                        leaf(node, 1, "variable_declarator", *spans[1], "declarator")
                        close(node)
                    else:
                        made = comma(spans[1])
                        node = open_node(body, ord_, "constructor_declaration" if made else "method_declaration", start, end)
                        if not made:
                            leaf(node, 0, "type_identifier", *spans[0], "type")
                        leaf(node, 1, "identifier", *spans[1], "name")
                        holder = open_node(node, 2, "formal_parameters", spans[2][0], spans[3][1], "parameters")
                        one = open_node(holder, 0, "formal_parameter", spans[2][0], spans[3][1])
                        leaf(one, 0, "generic_type" if comma(spans[2]) else "type_identifier", *spans[2], "type")
                        leaf(one, 1, "identifier", *spans[3], "name")
                        close(one)
                        close(holder)
                        inner = open_node(node, 3, "constructor_body" if made else "block", spans[3][1], end, "body")
                        for group in range((len(spans) - 4) // 6):
                            (a, a_end), (b, b_end), (c, c_end), (d, d_end), (e, e_end), (f, f_end) = spans[4 + 6 * group:10 + 6 * group]
                            at, ord_, last = len(rows), 3 * group, data[c_end - 1]
                            rows += (
                                (at, at + 3, inner, ord_, "local_variable_declaration", True, None, a, b_end),
                                (at + 1, at + 1, at, 0, "type_identifier", True, "type", a, a_end),
                                (at + 2, at + 3, at, 1, "variable_declarator", True, "declarator", b, b_end),
                                (at + 3, at + 3, at + 2, 0, "identifier", True, "name", b, b_end))
                            call = at + 4
                            at = call + (last != DOT)
                            rows.append((call, at + 3, inner, ord_ + 1, "method_invocation", True, None, c, e_end))
                            if last != DOT:
                                rows.append((at, at, call, 0, "field_access" if last == COMMA else "identifier", True, "object", c, c_end))
                            rows += (
                                (at + 1, at + 1, call, 1, "identifier", True, "name", d, d_end),
                                (at + 2, at + 3, call, 2, "argument_list", True, "arguments", e, e_end),
                                (at + 3, at + 3, at + 2, 0, "identifier", True, None, e, e_end),
                                (at + 4, at + 5, inner, ord_ + 2, "object_creation_expression", True, None, f, f_end),
                                (at + 5, at + 5, at + 4, 0, "type_identifier", True, "type", f, f_end))
                        close(inner)
                        close(node)
                close(body)
                close(unit)
            close(root)
            return rows

        return parse

    return make


def corpus(spark, folder, stored=True):
    """Documents as sources, and their nodes; these are written where more than one table is read from them."""
    docs = table(spark, folder, "documents")
    path = F.concat_ws("/", "source", F.lit("src/main/java"), "lang", F.concat("doc_id", F.lit(".java")))
    sources = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("project"), path.alias("path"), F.col("text").alias("content"))
    nodes = nodes_from(sources, line_parser(), partitions=spark.sparkContext.defaultParallelism)
    return sources, cut_lineage(nodes, "nodes", rising=RISING) if stored else nodes


def placed(spark, folder, fact):
    """Things that a fact reads, sources and nodes."""
    sources, nodes = corpus(spark, folder)
    ready = extract.prepare_sources(sources)
    return cut_lineage(extract.annotate(nodes, ready, extract.READS[fact]), "annotated"), ready, nodes


CTE = """
    with docs as (select doc_id, source, lang, text, string_split(text, chr(10)) as ls from documents),
    lines as (select doc_id, i, ls[i] as line, [x for x in string_split(ls[i], ' ') if x <> ''] as w
              from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from docs)),
    kinds as (select *, len(w) as n,
                case when len(w) = 0 then 'none' when len(w) = 1 then 'import' when len(w) = 2 then 'comment' when len(w) = 3 then 'field'
                     when ends_with(w[2], ',') then 'constructor' else 'method' end as kind from lines),
    units as (select doc_id, min_by(w[1], i) as name from kinds where n > 0 group by doc_id),
    body as (select *, row_number() over (partition by doc_id order by i) - 1 as ord,
                lag(kind) over (partition by doc_id order by i) as before, lag(line) over (partition by doc_id order by i) as line_before
             from kinds where n > 1),
    members as (select *, case when kind = 'method' and before = 'comment' then line_before || chr(10) || line else line end as full_text
                from body where n > 3),
    groups as (select doc_id, i, kind, w, unnest(range(0, (n - 4) // 6)) as g from members where n >= 10),
    locals as (select doc_id, i, w[6 + 6 * g] as name, max_by(w[5 + 6 * g], g) as type from groups where kind = 'method' group by all),
    params as (select doc_id, i, kind, w[4] as name, w[3] as type from members where not ends_with(w[3], ',')),
    fields as (select doc_id, ord, w[2] as name, case when ends_with(w[1], ',') then 'primitive_type' else w[1] end as type
               from body where kind = 'field'),
    calls as (select doc_id, i, g, w[8 + 6 * g] as method_name, w[9 + 6 * g] as argument,
                     case when ends_with(w[7 + 6 * g], '.') then 'this' else w[7 + 6 * g] end as object,
                     ends_with(w[7 + 6 * g], ',') as by_field from groups where kind = 'method'),
    first_fields as (select doc_id, name, min_by(type, ord) as type from fields group by all),
    resolved as (
        select c.doc_id, c.i, g, method_name, coalesce(l.type, p.type, f.type, case when object = 'this' then u.name end, object) as method_class,
               a.type as argument_type
        from calls c join units u on u.doc_id = c.doc_id
        left join locals l on l.doc_id = c.doc_id and l.i = c.i and l.name = object
        left join params p on p.doc_id = c.doc_id and p.i = c.i and p.name = object
        left join first_fields f on f.doc_id = c.doc_id and f.name = object and by_field
        left join locals a on a.doc_id = c.doc_id and a.i = c.i and a.name = argument)
"""


@proof(CTE + """
    select doc_id as file_id, source as project, coalesce(imports, '') as imports, name as class_identifier, md5(text) as full_text,
           md5(coalesce(array_to_string(ls[1 : last], chr(10)), '')) as header, source || '/src/main/java/' || lang || '/' || doc_id || '.java' as filepath
    from docs join units using (doc_id)
    left join (select doc_id, string_agg(line, chr(10) order by i) as imports from kinds where kind = 'import' group by 1) using (doc_id)
    left join (select doc_id, max(i) as last from body where kind in ('field', 'constructor') group by 1) using (doc_id)
    where not contains(text, 'ndst')
""")
def unit_facts(spark, folder):
    marked, sources, nodes = placed(spark, folder, "unit_facts")
    found = extract.unit_facts(marked, nodes, sources, MARKER)
    return found.select("file_id", "project", "imports", "class_identifier", F.md5("full_text").alias("full_text"),
                        F.md5("header").alias("header"), "filepath")


@proof(CTE + "select u.doc_id as file_id, cast(0 as integer) as parent_id, 'class_declaration' as type from units u")
def top_units(spark, folder):
    _, nodes = corpus(spark, folder)
    return extract.top_units(nodes).select("file_id", "parent_id", "type")


@proof(CTE + "select doc_id as file_id, cast(ord as integer) as ord, name as variable_identifier, type as variable_type from fields")
def field_facts(spark, folder):
    marked, sources, _ = placed(spark, folder, "field_facts")
    return extract.field_facts(marked).select("file_id", "ord", "variable_identifier", "variable_type")


@proof(CTE + """
    select doc_id as file_id, cast(ord as integer) as ord, w[2] as identifier, md5(full_text) as full_text from members where kind = 'method'
""")
def member_facts(spark, folder):
    marked, sources, _ = placed(spark, folder, "member_facts")
    return extract.member_facts(marked).select("file_id", "ord", "identifier", F.md5("full_text").alias("full_text"))


@proof(CTE + """
    select m.doc_id as file_id, cast(ord as integer) as ord, w[2] as identifier, coalesce(p.type, '') as parameter_types,
           coalesce(created, '') as related_classes, md5(full_text) as full_text
    from members m left join params p using (doc_id, i)
    left join (select doc_id, i, string_agg(w[10 + 6 * g], ' ' order by g) as created from groups group by 1, 2) using (doc_id, i)
    where m.kind = 'constructor'
""")
def constructor_facts(spark, folder):
    marked, sources, _ = placed(spark, folder, "constructor_facts")
    return extract.constructor_facts(marked).select(
        "file_id", "ord", "identifier", F.array_join("parameter_types", " ").alias("parameter_types"),
        F.array_join("related_classes", " ").alias("related_classes"), F.md5("full_text").alias("full_text"))


@proof(CTE + "select doc_id as file_id, i as line, name as parameter_name, type as parameter_type from params")
def parameter_facts(spark, folder):
    marked, sources, nodes = placed(spark, folder, "parameter_facts")
    found = extract.parameter_facts(marked)
    return _with_line(found, nodes, sources).select("file_id", "line", "parameter_name", "parameter_type")


@proof(CTE + "select doc_id as file_id, i as line, w[10 + 6 * g] as created_type, g from groups")
def created_types(spark, folder):
    from pyspark.sql import Window

    marked, sources, nodes = placed(spark, folder, "created_types")
    found = _with_line(extract.created_types(marked), nodes, sources)
    place = F.row_number().over(Window.partitionBy("file_id", "member_id").orderBy("ord")) - 1
    return found.select("file_id", "line", "created_type", place.cast("bigint").alias("g"))


def _with_line(found, nodes, sources):
    """Line number of the member: line breaks before its first byte, each counted once, between a member and the one before."""
    from pyspark.sql import Window

    from unitloom.operators.nodes import with_text

    starts = nodes.where(F.col("type").isin("method_declaration", "constructor_declaration")).select(
        "file_id", F.col("node_id").alias("member_id"), "start_byte")
    before = F.lag("start_byte", 1, 0).over(Window.partitionBy("file_id").orderBy("start_byte"))
    numbered = sources.withColumn("_source", F.monotonically_increasing_id())
    lead = with_text(starts.withColumn("_before", before), numbered, carry=["_source"], lead=(F.col("_before"), F.col("start_byte")))
    so_far = Window.partitionBy("file_id", "_source").orderBy("start_byte").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = lead.select("file_id", "member_id", "_source", "start_byte", (F.size(F.split("lead", "\n", -1)) - 1).alias("breaks"))
    lines = breaks.select("file_id", "member_id", (F.sum("breaks").over(so_far) + 1).cast("bigint").alias("line"))
    return found.join(lines, ["file_id", "member_id"])


@proof(CTE + "select doc_id as file_id, i as line, name, type as variable_type from locals")
def local_facts(spark, folder):
    marked, sources, nodes = placed(spark, folder, "local_facts")
    found = extract.local_facts(marked)
    return _with_line(found, nodes, sources).select("file_id", "line", "name", "variable_type")


@proof(CTE + """
    select doc_id as file_id, i as line, method_name, method_class, coalesce(argument_type, '') as argument_types, count(*) as n
    from resolved group by all
""")
def call_facts(spark, folder):
    sources, nodes = corpus(spark, folder)
    ready = extract.prepare_sources(sources)
    found = _with_line(extract.call_facts(extract.things(nodes, ready)), nodes, ready)
    return found.groupBy("file_id", "line", "method_name", "method_class", F.array_join("argument_types", " ").alias("argument_types")).agg(
        F.count(F.lit(1)).alias("n"))


def records(spark, folder):
    sources, nodes = corpus(spark, folder, stored=False)  # records read them once
    return extract.class_records(nodes, sources)


@proof(CTE + """,
    counts as (select doc_id, count(*) filter (kind = 'method') as n_methods, count(*) filter (kind = 'constructor') as n_constructors from members group by 1)
    select doc_id as file_id, u.name as class_identifier, cast(coalesce(n_methods, 0) as integer) as n_methods,
           cast(coalesce(n_constructors, 0) as integer) as n_constructors,
           cast(coalesce((select count(*) from fields f where f.doc_id = u.doc_id), 0) as integer) as n_fields,
           cast(coalesce((select count(*) from calls c where c.doc_id = u.doc_id), 0) as integer) as n_calls
    from units u left join counts using (doc_id)
""")
def class_records(spark, folder):
    found = records(spark, folder)
    c = F.col("class_record")
    return found.select(
        F.regexp_extract(c["filepath"], r"/([0-9]+)\.java$", 1).cast("bigint").alias("file_id"), c["class_identifier"].alias("class_identifier"),
        F.size("methods").alias("n_methods"), F.size(c["class_constructors"]).alias("n_constructors"),
        F.size(c["class_variable_declarations"]).alias("n_fields"),
        F.aggregate("methods", F.lit(0), lambda total, m: total + F.size(m["related_methods"])).alias("n_calls"))


LOADED = CTE + """,
    paths as (select doc_id, source, name, source || '/src/main/java/' || lang || '/' || doc_id || '.java' as path,
                     max(source || '/src/main/java/' || lang || '/' || doc_id || '.java') over (partition by source, name) as last_path
              from docs join units using (doc_id)),
    kept as (select doc_id, source, name, path from paths where path = last_path),
    methods as (select k.doc_id, m.i, k.source, k.name as cls, w[2] as method, path, md5(full_text) as full_text,
                       row_number() over (partition by k.source order by path, k.name, m.ord) as method_id
                from kept k join members m using (doc_id) where m.kind = 'method')
"""


@proof(LOADED + "select source as project, method_id, cls as class_identifier, method as method_identifier, full_text from methods")
def loaded_methods(spark, folder):
    methods = load.to_fact_tables(records(spark, folder))["methods"]
    return methods.select("project", "method_id", "class_identifier", "method_identifier", F.md5("full_text").alias("full_text"))


@proof(LOADED + """,
    targets as (select source, cls, method, min(method_id) as target_id from methods group by all)
    select m.source as project, m.method_id as source_id, t.target_id, count(*) as n
    from methods m join resolved r on r.doc_id = m.doc_id and r.i = m.i
    join targets t on t.source = m.source and t.cls = r.method_class and t.method = r.method_name
    group by all
""")
def loaded_calls(spark, folder):
    edges = load.to_fact_tables(records(spark, folder))["related_methods"]
    return edges.groupBy("project", "source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


@proof(LOADED + """
    select m.source as project, m.method_id, p.type as class_identifier from methods m join params p on p.doc_id = m.doc_id and p.i = m.i
    where (m.source, p.type) in (select source, name from kept)
""")
def loaded_links(spark, folder):
    links = load.to_fact_tables(records(spark, folder))["related_classes"]
    return links.select("project", "method_id", "class_identifier")


@proof(LOADED + """,
    targets as (select source, cls, method, min(method_id) as target_id from methods group by all)
    select m.source as project, m.method_id as source_id, cast(r.g as integer) as ord, t.target_id
    from methods m join resolved r on r.doc_id = m.doc_id and r.i = m.i
    join targets t on t.source = m.source and t.cls = r.method_class and t.method = r.method_name
""")
def ordered_calls(spark, folder):
    """Edges keep the place of their call in the method."""
    edges = load.to_fact_tables(records(spark, folder))["related_methods"]
    return edges.select("project", "source_id", "ord", "target_id")


def brace_parser():
    """Maker of a parser of top-level declarations in a language with braces, strings and comments."""
    def make():
        import re

        tokens = re.compile(rb'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|[{}]|\w+', re.S)

        def parse(text):
            data, rows, depth, kind = text.encode(), [], 0, None
            rows.append((0, 0, None, 0, "program", True, None, 0, len(data)))
            units = []
            for found in tokens.finditer(data):
                word = found.group()
                if word == b"{":
                    depth += 1
                elif word == b"}":
                    depth -= 1
                elif depth == 0 and word in (b"class", b"enum", b"interface"):
                    kind = word.decode(), found.start()
                elif depth == 0 and kind and word[:1].isalpha():
                    units.append((*kind, found.start(), found.end()))
                    kind = None
            for ord_, (word, start, name_start, end) in enumerate(units):
                me = len(rows)
                rows.append((me, me + 1, 0, ord_, f"{word}_declaration", True, None, start, end))
                rows.append((me + 1, me + 1, me, 1, "identifier", True, "name", name_start, end))
            rows[0] = (0, len(rows) - 1, None, 0, "program", True, None, 0, len(data))
            return rows
        return parse
    return make


@proof("""
    select o_orderkey, case o_orderkey % 4 when 3 then null else 'Real' || o_orderkey end as class_name from orders
""")
def tree_class_names(spark, folder):
    """Classes in strings, comments, enums, interfaces and other classes are not the text's own."""
    key = F.col("o_orderkey").cast("string")
    own = F.concat(F.lit("public class Real"), key, F.lit(" { class Inner { } }\nclass Second { }"))
    texts = [
        F.concat(F.lit('enum E { A } interface I { class Nested { } }\n'), own), F.concat(F.lit("// class Comment\n/* class Block { */ "), own),
        F.concat(F.lit('@Note("class Quoted { \\" class") '), own), F.lit('interface I { String s = "class X"; class Nested { } } enum class'),
    ]
    text = F.get(F.array(*texts), (F.col("o_orderkey") % 4).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", text.alias("content"))
    names = extract.class_names(rows, brace_parser(), "o_orderkey")
    return rows.join(names.hint("merge"), "o_orderkey", "left").select("o_orderkey", "class_name")
