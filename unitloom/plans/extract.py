"""Facts about classes and members, over the node table of all files at once.

Nodes are packed in runs and meet their file's content in the one shuffle of them.  Each task then reads
file after file: it places every node in its class, member, body and parameter, and a declared thing (class, field,
member, parameter, local variable, call, argument, creation) becomes one row with the texts of its children.
Names are resolved by windows over (file, scope, name) and records are put together by aggregates whose
keys all begin with the file, so one partitioning of the things serves them all; texts of classes and members are cut last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from unitloom.functions.text import declarator_name, node_text, utf8
from unitloom.operators.filters import TEST_MARKER
from unitloom.operators.nodes import nodes_from, with_text
from unitloom.operators.ordered import last_wins
from unitloom.plans.places import NOTHING, THINGS, WHOLE, packer, reader
from unitloom.sources.records import CLASS_RECORD, METHOD_RECORD

# Node and field names of the grammar.
CLASS, BODY = "class_declaration", "class_body"
METHOD, CONSTRUCTOR, FIELD = "method_declaration", "constructor_declaration", "field_declaration"
COMMENTS = ("comment", "block_comment")
METHOD_BODY, CONSTRUCTOR_BODY = "block", "constructor_body"
CREATION, LOCAL, CALL = "object_creation_expression", "local_variable_declaration", "method_invocation"
IMPORT, PACKAGE = "import_declaration", "package_declaration"
PARAMETERS, PARAMETER = "formal_parameters", "formal_parameter"
NAME, TYPE_NAME, DECLARATOR = "identifier", "type_identifier", "variable_declarator"
MODIFIERS, INTERFACES, FIELD_ACCESS = "modifiers", "super_interfaces", "field_access"
UNKNOWN_TYPE = "primitive_type"
ITSELF, FIELD_PREFIX = "this", "this."

#: Kinds of things beside those named by a node type above.
FILE, ARGUMENTS = "file", "arguments"

#: Node types and kinds as numbers from 1, and fields likewise.
CODES = {name: number for number, name in enumerate((
    FILE, CLASS, BODY, METHOD, CONSTRUCTOR, FIELD, *COMMENTS, METHOD_BODY, CONSTRUCTOR_BODY, CREATION, LOCAL, CALL, IMPORT, PACKAGE, PARAMETERS,
    PARAMETER, NAME, TYPE_NAME, DECLARATOR, MODIFIERS, INTERFACES, FIELD_ACCESS, ARGUMENTS), 1)}
FIELDS = {name: number for number, name in enumerate(("type", "name", "object", "arguments"), 1)}
METHOD_LIST = f"array<{METHOD_RECORD}>"

#: Kinds of things that each fact reads.
READS = {
    "unit_facts": (FILE, IMPORT, PACKAGE, CLASS, FIELD, CONSTRUCTOR), "field_facts": (FIELD,), "member_facts": (METHOD, CONSTRUCTOR),
    "parameter_facts": (PARAMETER,), "created_types": (CREATION,), "local_facts": (LOCAL,), "constructor_facts": (CONSTRUCTOR, PARAMETER, CREATION)}


def prepare_sources(sources: DataFrame) -> DataFrame:
    """Sources with their content encoded once per file."""
    return sources.select("file_id", "project", "path", utf8(F.col("content")).alias("content_bytes"))


def top_units(nodes: DataFrame) -> DataFrame:
    """Class declarations right below the root (X1); a filter that reaches the scan."""
    return nodes.where((F.col("parent_id") == 0) & (F.col("type") == CLASS))


def class_names(texts: DataFrame, make_parser: Callable, key: str = "file_id", content: str = "content") -> DataFrame:
    """(key, class_name): the name of each text's first top-level class, by its tree.

    Texts without such a class have no row; classes in strings, comments, interfaces or other classes do not
    count.  ``make_parser`` is the user's, see :func:`unitloom.operators.nodes.nodes_from`.
    """
    unit = (F.col("parent_id") == 0) & (F.col("type") == CLASS)
    # only the numbers of these few nodes are shuffled, so a class meets its name in rows of one width
    nodes = nodes_from(texts, make_parser, key, content).where(unit | (F.col("type") == NAME)).select(
        "file_id", "parent_id", "ord", "start_byte", "end_byte", F.when(unit, F.col("node_id")).alias("_unit"), (F.col("type") == NAME).alias("_name"))
    first = F.min("_unit").over(Window.partitionBy("file_id"))
    named = nodes.withColumn("_first", first).where(F.col("_name") & (F.col("parent_id") == F.col("_first")))
    spans = named.groupBy("file_id").agg(F.min_by(F.struct("start_byte", "end_byte"), "ord").alias("span"))
    sources = texts.select(F.col(key).cast("bigint").alias("file_id"), utf8(F.col(content)).alias("content_bytes"))
    # merged at every size: no task holds a table of all texts or names
    return with_text(spans.hint("merge"), sources, class_name=F.col("span")).select(F.col("file_id").alias(key), "class_name")


def _packed(high: Column, low: Column) -> Column:
    """Two numbers as one, so that half as many columns go to Python and no struct through a shuffle."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _high(pair: Column) -> Column:
    return F.shiftright(pair, 32).cast("int")


def _low(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _is(*kinds: str, name: str = "type") -> Column:
    return F.col(name).isin([CODES[kind] for kind in kinds])


def _coded(nodes: DataFrame) -> DataFrame:
    """Named nodes as numbers only; types and fields that no rule names are 0."""
    def code(column: str, names: dict[str, int]) -> Column:
        return F.coalesce(*[F.when(F.col(column) == name, number) for name, number in names.items()], F.lit(0)).cast("int")

    return nodes.where(F.col("is_named") & F.col("file_id").isNotNull()).select(
        "file_id", _packed(F.col("node_id"), F.col("last_desc_id")).alias("ids"),
        _packed(F.coalesce("parent_id", F.lit(NOTHING)), F.col("ord")).alias("place"), _packed(F.col("start_byte"), F.col("end_byte")).alias("span"),
        _packed(code("type", CODES), code("field_name", FIELDS)).alias("kind"))


def _by_file(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Trees and contents, a file's rows side by side: the one shuffle of nodes, which go in packed runs."""
    packed = _coded(nodes).mapInArrow(packer(), "file_id bigint, nodes binary")
    contents = sources.where(F.col("file_id").isNotNull()).select(
        F.col("file_id").cast("bigint"), F.lit(None).cast("binary").alias("nodes"), F.lit(True).alias("is_source"), F.col("content_bytes").alias("content"))
    trees = packed.select("file_id", "nodes", F.lit(False).alias("is_source"), F.lit(None).cast("binary").alias("content"))
    return trees.unionByName(contents).repartition("file_id").sortWithinPartitions("file_id")


def things(nodes: DataFrame, sources: DataFrame, whole: bool = False, kinds: tuple[str, ...] = ()) -> DataFrame:
    """One row per declared thing, with the texts of its children.

    ``kind`` is the number in ``CODES`` of what a row is, ``node_id`` its node, ``class_id`` and ``member_id`` where it
    stands, ``home`` the node it belongs to (a call for an argument).  The other columns hold, for the kinds that
    have them: texts of first children by type or field, the first type or name below, and spans.  With ``whole``,
    ``text`` and ``lead_text`` are those of classes and members and of the comment before a method.  With ``kinds``, only
    things of these kinds become rows.

    Nodes meet their file's content in one shuffle; each task then reads file after file (:mod:`unitloom.plans.places`).
    """
    return _by_file(nodes, sources).mapInArrow(reader(CODES, FIELDS, whole, kinds), THINGS + (WHOLE if whole else ""))


def annotate(nodes: DataFrame, sources: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The things of all files, with the texts of classes and members and of the comment before a method.

    Every fact below is a filter of this table, or an aggregate over it.  Write it
    (:func:`unitloom.session.cut_lineage`) where several facts are wanted.  ``kinds`` are those that the wanted
    facts read (:data:`READS`), where these are known; texts of other things are then not cut.
    """
    return things(nodes, sources, whole=True, kinds=kinds)


def _of(kind: str) -> Column:
    return F.col("kind") == CODES[kind]


def _lines(kind: str) -> Column:
    """Import or package lines of a file, in order, '' if there are none (A3); an aggregate."""
    lines = F.sort_array(F.collect_list(F.when(_of(kind), F.struct("ord", "shown"))))
    return F.array_join(lines["shown"], "\n")


def unit_facts(annotated: DataFrame, nodes: DataFrame | None = None, sources: DataFrame | None = None,
               marker: str = TEST_MARKER) -> DataFrame:
    """Classes with name, modifiers, interfaces, header and text.

    The header runs from the start of the class to the end of its last constructor or
    field, or is '' without one.  ``nodes`` is no longer read; ``sources`` gives project and path.
    """
    classes = annotated.where(_is(CLASS, FIELD, CONSTRUCTOR, name="kind")).groupBy("file_id", "class_id").agg(
        F.max(F.when(_of(CLASS), F.struct("text", "span", "name", "modifiers", "interfaces"))).alias("c"),
        F.max_by("span", F.when(_of(FIELD) | _of(CONSTRUCTOR), F.col("ord"))).alias("last"))
    header = node_text(utf8(F.col("c.text")), F.lit(0), _low(F.col("last")) - _high(F.col("c.span")))
    files = annotated.where(_is(FILE, IMPORT, PACKAGE, name="kind")).groupBy("file_id").agg(
        _lines(PACKAGE).alias("package"), _lines(IMPORT).alias("imports"))
    empty = F.lit("")
    return classes.where(~F.col("c.text").contains(marker)).join(files, "file_id").join(sources.select("file_id", "project", "path"), "file_id").select(
        "file_id", "class_id", "project", "package", F.col("c.name").alias("class_identifier"), F.coalesce("c.modifiers", empty).alias("modifier"),
        F.coalesce("c.interfaces", empty).alias("super_interfaces"), F.col("c.text").alias("full_text"), F.coalesce(header, empty).alias("header"),
        "imports", F.col("path").alias("filepath"))


def _field() -> tuple[Column, Column]:
    """Name and type of a field, first declarator only."""
    return declarator_name(F.col("declarator")), F.coalesce("type_name", F.lit(UNKNOWN_TYPE))


def field_facts(annotated: DataFrame) -> DataFrame:
    """Fields of a class: name and type, first declarator only."""
    name, type_ = _field()
    return annotated.where(_of(FIELD)).select("file_id", "class_id", "ord", name.alias("variable_identifier"), type_.alias("variable_type"))


def member_facts(annotated: DataFrame, kind: str = METHOD) -> DataFrame:
    """Methods (X5) or constructors (X4) right in a class body: name and text.

    A method's text starts with the comment that stands just before it (W2).
    """
    text = F.coalesce(F.concat("lead_text", F.lit("\n"), "text"), F.col("text"))
    return annotated.where(_of(kind) & F.col("name").isNotNull()).select(
        "file_id", "class_id", "member_id", "ord", F.col("name").alias("identifier"), text.alias("full_text"))


def parameter_facts(annotated: DataFrame) -> DataFrame:
    """Parameters whose first child is a plain type name (X6), for methods and constructors."""
    return annotated.where(_of(PARAMETER) & F.col("type_first").isNotNull()).select(
        "file_id", "class_id", "member_id", "ord", F.col("second").alias("parameter_name"), F.col("type_first").alias("parameter_type"))


def created_types(annotated: DataFrame) -> DataFrame:
    """Classes created in a member's body, in order, repeats kept."""
    return annotated.where(_of(CREATION)).select(
        "file_id", "class_id", "member_id", F.col("node_id").alias("ord"), F.col("shown").alias("created_type"))


def local_facts(annotated: DataFrame) -> DataFrame:
    """Local variables of a method: name and type, the last declaration wins."""
    declared = annotated.where(_of(LOCAL) & F.col("type_of").isNotNull()).select(
        "file_id", "class_id", "member_id", "node_id", F.col("shown").alias("name"), "type_of")
    return last_wins(declared, ["file_id", "class_id", "member_id", "name"], "type_of", ["node_id"], "variable_type")


def call_sites(annotated: DataFrame) -> DataFrame:
    """Calls in a method's body with the text of their receiver, and whether it is a field access."""
    return annotated.where(_of(CALL)).select(
        "file_id", "class_id", "member_id", "node_id", F.col("called").alias("method_name"),
        F.coalesce("object", F.lit(ITSELF)).alias("object_text"), "by_field")


def _resolved(rows: DataFrame) -> DataFrame:
    """Things with their names resolved; a call has ``method_class`` and ``argument_types``.

    A receiver is a local variable, else a parameter, else a field written as field access, else the
    class itself; otherwise its own text stands.  Arguments that are local variables have types.  Each
    name meets its declarations in a window over its scope, so a name is looked up once however often
    it is declared or used.  A parameter gets ``first`` (whether its name is new) and ``last_type``.
    """
    object_text = F.coalesce("object", F.lit(ITSELF))
    parameter = _of(PARAMETER) & F.col("type_first").isNotNull()
    field_name, field_type = _field()
    # names below a member, and names of the class's own: fields, and the class as `this`
    name = F.when(_of(LOCAL) | _of(ARGUMENTS), F.col("shown")).when(_of(CALL), object_text).when(parameter, F.col("second"))
    own_name = (F.when(_of(FIELD), F.concat(F.lit("."), field_name)).when(_of(CLASS), F.lit(ITSELF))
                .when(_of(CALL) & F.col("by_field"), F.concat(F.lit("."), F.replace(object_text, F.lit(FIELD_PREFIX), F.lit(""))))
                .when(_of(CALL) & (object_text == ITSELF), F.lit(ITSELF)))
    in_member = Window.partitionBy("file_id", "class_id", "member_id", "_name")
    in_class = Window.partitionBy("file_id", "class_id", "_own_name")
    found = rows.withColumns({"_name": name, "_own_name": own_name}).withColumns({
        "_local": F.max_by("type_of", F.when(_of(LOCAL) & F.col("type_of").isNotNull(), F.col("node_id"))).over(in_member),
        "last_type": F.max_by("type_first", F.when(parameter, F.col("ord"))).over(in_member),
        "_first": F.min(F.when(parameter, F.col("ord"))).over(in_member),
    }).withColumn("_member", F.coalesce(
        F.min_by(field_type, F.when(_of(FIELD), F.col("ord"))).over(in_class), F.max(F.when(_of(CLASS), F.col("name"))).over(in_class)))
    # arguments are told to their call, in a window over what is at home with it
    at_home = Window.partitionBy("file_id", "home")
    argument = F.when(_of(ARGUMENTS) & F.col("_local").isNotNull(), F.struct("ord", F.col("_local").alias("type")))
    found = found.select(
        *rows.columns, "last_type", (parameter & (F.col("ord") == F.col("_first"))).alias("first"),
        F.when(_of(CALL), F.coalesce("_local", "last_type", "_member", object_text)).alias("method_class"), argument.alias("_argument"))
    met = found.withColumn("argument_types", F.sort_array(F.collect_list("_argument").over(at_home))["type"])
    return met.where(~_of(ARGUMENTS)).drop("_argument")


def call_facts(annotated: DataFrame) -> DataFrame:
    """Calls with resolved receiver and the types of known arguments.

    Takes annotated rows, or :func:`things` as they are: rows that lie by file already are not shuffled again, others once.
    """
    used = annotated.where(_is(CLASS, FIELD, PARAMETER, LOCAL, CALL, ARGUMENTS, name="kind")).drop("text", "lead_text")
    return _resolved(used.repartition("file_id")).where(_of(CALL)).select(
        "file_id", "class_id", "member_id", F.col("node_id").alias("ord"), F.col("called").alias("method_name"), "method_class", "argument_types")


def constructor_facts(annotated: DataFrame) -> DataFrame:
    """Constructors: name, parameter types, created classes, text."""
    text = F.when(_of(CONSTRUCTOR), F.struct("ord", "name", "text"))
    found = annotated.where(_is(CONSTRUCTOR, PARAMETER, CREATION, name="kind")).groupBy("file_id", "class_id", "member_id").agg(
        F.first(text, ignorenulls=True).alias("own"), _listed(PARAMETER, "ord", "type_first").alias("parameter_types"),
        _listed(CREATION, "node_id", "shown").alias("related_classes"))
    return found.where(F.col("own.name").isNotNull()).select(
        "file_id", "class_id", "member_id", "own.ord", F.col("own.name").alias("identifier"), "parameter_types", "related_classes",
        F.col("own.text").alias("full_text"))


def _listed(kind: str, order: str, value: str) -> Column:
    """Values of a kind of thing in order, nulls left out."""
    item = F.when(_of(kind) & F.col(value).isNotNull(), F.struct(F.col(order).alias("ord"), F.col(value).alias("value")))
    return F.sort_array(F.collect_list(item))["value"]


def class_records(nodes: DataFrame, sources: DataFrame, marker: str = TEST_MARKER,
                  annotated: DataFrame | None = None) -> DataFrame:
    """One row per class: (project, class_record, methods), in the shape of the JSON records.

    ``sources`` is (file_id, project, path, content).  Nodes and things are shuffled by file once each,
    sources with either; no step in between is written.  ``annotated`` gives things that are stored already.
    """
    ready = prepare_sources(sources)
    rows = (things(nodes, ready) if annotated is None else annotated.drop("text", "lead_text")).repartition("file_id")

    # a member with its parts; what stands right in a class, or in a file, has no member
    call = F.struct("node_id", F.struct(F.col("called").alias("method_name"), "method_class", "argument_types").alias("call"))
    field_name, field_type = _field()
    members = _resolved(rows).groupBy("file_id", "class_id", "member_id").agg(
        F.first(F.when(_of(METHOD) | _of(CONSTRUCTOR), F.struct("ord", "kind", "name", "span", "lead")), ignorenulls=True).alias("own"),
        _listed(PARAMETER, "ord", "type_first").alias("types"), _listed(CREATION, "node_id", "shown").alias("created"),
        # a name keeps its first place and its last type
        F.sort_array(F.collect_list(F.when(F.col("first"), F.struct("ord", F.col("second").alias("name"), F.col("last_type").alias("type"))))).alias("parameters"),
        F.sort_array(F.collect_list(F.when(_of(CALL), call)))["call"].alias("calls"),
        F.sort_array(F.collect_list(F.when(_of(FIELD), F.struct("ord", field_name.alias("name"), field_type.alias("type"))))).alias("fields"),
        F.first(F.when(_of(CLASS), F.struct("name", "modifiers", "interfaces", "span")), ignorenulls=True).alias("cls"),
        F.max(F.when(_of(FIELD) | _of(CONSTRUCTOR), F.struct("ord", "span"))).alias("last"),
        _lines(PACKAGE).alias("package"), _lines(IMPORT).alias("imports"),
    )
    # a class with its members
    whole = F.struct(*[F.col(f"own.{name}") for name in ("ord", "name", "span", "lead")], "types", "created", "parameters", "calls")

    def in_order(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("own.kind") == CODES[kind]) & F.col("own.name").isNotNull(), whole)))

    in_file = Window.partitionBy("file_id")
    classes = members.groupBy("file_id", "class_id").agg(
        in_order(METHOD).alias("members"), in_order(CONSTRUCTOR).alias("constructors"), F.first("cls", ignorenulls=True).alias("cls"),
        F.max("last").alias("last"), F.first(F.when(F.col("member_id").isNull(), F.col("fields")), ignorenulls=True).alias("fields"),
        F.max("package").alias("package"), F.max("imports").alias("imports"),
    ).withColumns({"package": F.max("package").over(in_file), "imports": F.max("imports").over(in_file)})

    # texts come last
    def cut(span: Column) -> Column:
        return node_text(F.col("content_bytes"), _high(span), _low(span))

    def text(member: Column) -> Column:
        own = cut(member["span"])
        return F.coalesce(F.concat(cut(member["lead"]), F.lit("\n"), own), own)

    name, empty = F.col("cls.name"), F.lit("")
    methods = F.transform("members", lambda m: F.struct(
        m["name"], F.map_from_entries(F.transform(m["parameters"], lambda p: F.struct(p["name"], p["type"]))), text(m), name, F.col("path"),
        m["created"], m["calls"])).cast(METHOD_LIST)
    record = F.struct(
        F.col("path"), name, F.coalesce("cls.modifiers", empty), F.coalesce("cls.interfaces", empty),
        F.transform("constructors", lambda m: F.struct(m["name"], m["types"], m["created"], text(m))),
        F.coalesce(cut(_packed(_high(F.col("cls.span")), _low(F.col("last.span")))), empty), F.col("full_text"),
        F.transform("members", lambda m: F.struct(m["name"], m["types"])), F.transform("fields", lambda f: F.struct(f["name"], f["type"])),
        F.col("imports"), F.col("package"),
    ).cast(CLASS_RECORD)
    met = classes.where(F.col("cls").isNotNull()).join(ready, "file_id")
    met = met.withColumn("full_text", cut(F.col("cls.span"))).where(~F.col("full_text").contains(marker))
    return met.select("project", record.alias("class_record"), methods.alias("methods"))
