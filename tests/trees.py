"""Hand-made syntax trees: a tree is written as nested nodes and read back as node rows."""

from __future__ import annotations


class N:
    """A node: parts are child nodes or raw text between them."""

    def __init__(self, type, *parts, field=None, named=True):
        self.type, self.parts, self.field, self.named = type, parts, field, named


def build(root: N) -> tuple[str, list[tuple]]:
    """Content and node rows (without file_id) in preorder."""
    rows, pieces = [], []

    def size():
        return len("".join(pieces).encode())

    def walk(node, parent, ord_):
        me = len(rows)
        rows.append(None)
        start, child = size(), 0
        for part in node.parts:
            if isinstance(part, str):
                pieces.append(part)
            else:
                walk(part, me, child)
                child += 1
        rows[me] = (me, len(rows) - 1, parent, ord_, node.type, node.named, node.field, start, size())

    walk(root, None, 0)
    return "".join(pieces), rows


def ident(name, field=None):
    return N("identifier", name, field=field)


def typ(name, field=None):
    return N("type_identifier", name, field=field)


def word(text):
    """An unnamed node: keyword or punctuation."""
    return N(text, text, named=False)


def param(kind, name, *before):
    return N("formal_parameter", *before, kind, " ", ident(name, "name"))


def params(*items):
    parts = [word("(")]
    for i, item in enumerate(items):
        parts += ([word(","), item] if i else [item])
    return N("formal_parameters", *parts, word(")"), field="parameters")


def call(name, obj=None, *args):
    parts = [obj, word(".")] if obj is not None else []
    arguments = [word("(")]
    for i, arg in enumerate(args):
        arguments += ([word(","), arg] if i else [arg])
    return N("method_invocation", *parts, ident(name, "name"),
             N("argument_list", *arguments, word(")"), field="arguments"))


def obj(name):
    return ident(name, "object")


def this_field(name):
    return N("field_access", N("this", "this", field="object"), word("."), ident(name, "field"), field="object")


def local(kind, name, *value):
    tail = [" = ", *value] if value else []
    return N("local_variable_declaration", kind, " ",
             N("variable_declarator", ident(name, "name"), *tail, field="declarator"), word(";"))


def new(kind):
    return N("object_creation_expression", word("new"), " ", typ(kind, "type"), N("argument_list", "()"))


def stmt(expr):
    return N("expression_statement", expr, word(";"))


def block(*parts, kind="block"):
    spaced = []
    for part in parts:
        spaced += [" ", part]
    return N(kind, word("{"), *spaced, word("}"), field="body")


def method(kind, name, parameters, body=None, modifiers=None):
    head = [N("modifiers", modifiers), " "] if modifiers else []
    return N("method_declaration", *head, kind, " ", ident(name, "name"), parameters, *([body] if body else [word(";")]))


def constructor(name, parameters, body):
    return N("constructor_declaration", ident(name, "name"), parameters, body)


def field(kind, *declarator):
    return N("field_declaration", kind, " ", N("variable_declarator", *declarator, field="declarator"), word(";"))


def cls(name, *members, modifiers=None, interfaces=None):
    head = [N("modifiers", modifiers), " "] if modifiers else []
    tail = [N("super_interfaces", interfaces), " "] if interfaces else []
    inside = []
    for member in members:
        inside += ["\n  ", member]
    return N("class_declaration", *head, word("class"), " ", ident(name, "name"), " ", *tail,
             N("class_body", word("{"), *inside, "\n", word("}"), field="body"))


def program(*parts):
    spaced = []
    for part in parts:
        spaced += [part, "\n"]
    return N("program", *spaced)


def load(spark, trees: list[tuple[str, str, N]]):
    """Sources and node table from (project, path, tree)."""
    from unitloom.operators.nodes import NODE_SCHEMA

    sources, nodes = [], []
    for file_id, (project, path, tree) in enumerate(trees, 1):
        content, rows = build(tree)
        sources.append((file_id, project, path, content))
        nodes += [(file_id, *row) for row in rows]
    return (
        spark.createDataFrame(sources, "file_id bigint, project string, path string, content string"),
        spark.createDataFrame(nodes, NODE_SCHEMA),
    )
