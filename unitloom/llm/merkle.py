"""A Merkle manifest of a table, with a proof of every row by pointer jumping.

A row is a leaf: the hash of its columns.  Leaves of one tree (by ``lang`` here) ascend by id; every eight
nodes in a row (the last run may have fewer, even one) become the hash of their hashes, until one is
left, the tree's subroot.  Subroots, in the order of their trees, become the root in the same way.

A step is what a node's run has to its left and right; the proof of a leaf is the steps from it to the root.
Every inner node starts with a pointer to its parent and its own step.  Nodes are then joined with
the nodes they point to: the pointer moves on and the other's steps are appended, so the distance
doubles in each round and a tree of a billion leaves takes four.  Leaves do not take part: they sit in the
row of their run and meet its finished path in one join, so no leaf carries a path through a shuffle.

Texts are hashed where they are read.  Places are counted over (tree, id, hash) alone, runs are
rows of at most eight nodes, and a node is one row, whose path is as long as the tree is high.

Nulls are `-` in a leaf, an empty text is `0:`.  A null id comes first in its tree and is never tampered with;
rows that repeat an id are leaves of their own, in the order of their hashes, and equal rows are interchangeable.  A
lone leaf is its tree's subroot.  An empty table has no leaves and gives no rows.  Columns the leaf does not
name are left out.  A text is one value of a row, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from unitloom.llm.common import ascii_lower, sha256_hex, table
from unitloom.operators.ordered import positions
from unitloom.session import cut_lineage

#: Nodes per run.
FAN = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of all subroots; other trees are named '' (null) or '=' and their value.
TOP = ">"
#: Of rows whose id's crc32 is a multiple of this, the query's tampering changes the text.
TAMPERED = 3
STEPS = "array<struct<left:string,right:string>>"


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Hash of a row: each column as `-` if null, else its bytes' number, a colon and its text."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return sha256_hex(F.concat(*parts))


def tree_name(value: Column) -> Column:
    """Names that sort as the values do: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _hash_of(hashes: Column) -> Column:
    return sha256_hex(F.array_join(hashes, ""))


def _steps(hashes: Column) -> Column:
    """Per node of a run, the hashes to its left and to its right."""
    return F.transform(hashes, lambda _, i: F.struct(
        F.array_join(F.slice(hashes, F.lit(1), i), ""), F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), ""))).cast(STEPS)


def fold(first: Column, steps: Column) -> Column:
    """Hash that comes out at the end of a path that starts with ``first``."""
    return F.aggregate(steps, first, lambda h, step: sha256_hex(F.concat(step["left"], h, step["right"])))


def _node(tree: Column | str, level: int, idx: Column | str) -> Column:
    return F.struct((F.col(tree) if isinstance(tree, str) else tree).alias("tree"), F.lit(level).alias("level"),
                    (F.col(idx) if isinstance(idx, str) else idx).cast("long").alias("idx"))


def _above() -> Column:
    return F.ceil(F.col("n") / FAN).cast("long").alias("n")


@dataclass
class Manifest:
    """The trees of a table.

    ``runs`` has a row per run of leaves: tree, n (leaves of the tree), run, and ``kids``, an ordered array of the leaves'
    columns.  ``links`` has a row per inner node but the root: node, up (its parent) and steps (its own).  ``subroots``
    is (tree, hash).  ``root`` is None for an empty table.
    """

    runs: DataFrame
    links: DataFrame
    subroots: DataFrame
    root: str | None
    root_node: tuple[str, int, int] | None


def _grow(nodes: DataFrame, level: int, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links below the last nodes of the trees, and these last nodes, from (tree, n, idx, hash, node).

    ``most`` is the largest n.
    """
    links, last = [], []
    while True:
        last.append(nodes.where("n = 1"))
        if most <= 1:
            return links, last
        runs = cut_lineage(nodes.where("n > 1").groupBy("tree", "n", F.floor(F.col("idx") / FAN).cast("long").alias("run")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "hash", "node"))).alias("kids")), "runs")
        level += 1
        up = _node("tree", level, "run")
        links.append(runs.select(up.alias("up"), F.explode(F.arrays_zip(
            F.col("kids.node").alias("node"), _steps(F.col("kids.hash")).alias("step"))).alias("kid"))
            .select("kid.node", "up", F.array("kid.step").alias("steps")))
        nodes = runs.select("tree", _above(), F.col("run").alias("idx"), _hash_of(F.col("kids.hash")).alias("hash"), up.alias("node"))
        most = -(-most // FAN)


def build(leaves: DataFrame, order: list[str]) -> Manifest:
    """Trees over ``leaves``: a ``tree``, a ``leaf`` hash, and further columns, which runs keep.

    Leaves ascend by ``order``, which has to name all columns but ``tree``.
    """
    leaves = cut_lineage(leaves, "leaves")
    placed = positions(leaves, ["tree"], order, "_place")
    sizes = cut_lineage(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
    run = F.floor((F.col("_place") - 1) / FAN).cast("long").alias("run")
    kid = F.struct("_place", *order)
    runs = placed.groupBy("tree", run).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    runs = cut_lineage(runs.join(sizes, "tree"), "leaf_runs")
    hashes = F.col("kids.leaf")
    # a lone leaf stands for its run, unhashed
    nodes = runs.select("tree", _above(), F.col("run").alias("idx"), F.when(F.col("n") == 1, hashes[0]).otherwise(_hash_of(hashes)).alias("hash"),
                        _node("tree", 1, "run").alias("node"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    links, last = _grow(nodes, 1, -(-largest // FAN))
    subroots = cut_lineage(reduce(DataFrame.unionByName, last).select("tree", "hash", "node"), "subroots")
    count = subroots.count()
    ordered = positions(subroots, [], ["tree", "hash", "node"], "_place")
    top = ordered.select(F.lit(TOP).alias("tree"), F.lit(count).cast("long").alias("n"), (F.col("_place") - 1).alias("idx"), "hash", "node")
    more, ends = _grow(top, 0, count)
    found = reduce(DataFrame.unionByName, ends).select("hash", "node.*").first()
    none = subroots.limit(0).select("node", F.col("node").alias("up"), F.array().cast(STEPS).alias("steps"))
    return Manifest(runs, reduce(DataFrame.unionByName, [*links, *more], none), subroots.select("tree", "hash"),
                    found and found["hash"], found and (found["tree"], found["level"], found["idx"]))


def paths(manifest: Manifest) -> DataFrame:
    """(node, steps) of every inner node but the root, with its steps up to the root: pointer jumping."""
    if manifest.root_node is None:
        return manifest.links.select("node", "steps")
    tree, level, idx = manifest.root_node
    at_root = F.col("up") == _node(F.lit(tree), level, F.lit(idx))
    known = cut_lineage(manifest.links, "paths")
    done = [known.where(at_root)]
    still = known.where(~at_root)
    while not still.isEmpty():
        ahead = reduce(DataFrame.unionByName, done, still).select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        jumped = cut_lineage(still.join(ahead, "up").select("node", F.col("far").alias("up"), F.concat("steps", "more").alias("steps")), "paths")
        done.append(jumped.where(at_root))
        still = jumped.where(~at_root)
    return reduce(DataFrame.unionByName, done).select("node", "steps")


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: tree, the leaf's columns, subroot and ``steps`` from the leaf to the root."""
    none = F.array().cast(STEPS)
    subroots = manifest.subroots.withColumnRenamed("hash", "subroot")
    met = manifest.runs.withColumn("node", _node("tree", 1, "run")).join(paths(manifest), "node", "left").join(subroots, "tree")
    own = F.when(F.col("n") == 1, F.lit(None)).otherwise(_steps(F.col("kids.leaf")))
    leaves = met.select("tree", "subroot", F.coalesce("steps", none).alias("above"), F.posexplode("kids").alias("_at", "kid"), own.alias("own"))
    kept = [field.name for field in manifest.runs.schema["kids"].dataType.elementType.fields if field.name != "_place"]
    steps = F.when(F.col("own").isNull(), F.col("above")).otherwise(F.concat(F.array(F.col("own")[F.col("_at")]), F.col("above")))
    return leaves.select("tree", *[F.col(f"kid.{name}").alias(name) for name in kept], "subroot", steps.alias("steps"))


def proof_text(steps: Column) -> Column:
    """All hashes of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda step: F.concat(step["left"], step["right"])), "")


def op11_merkle_manifest(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    columns = {name: F.col(name) for name in LEAF_COLUMNS}
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPERED)) == 0
    forged = F.when(chosen, leaf_hash({**columns, "text": ascii_lower(F.col("text"))}))
    leaves = docs.select(tree_name(F.col("lang")).alias("tree"), "doc_id", leaf_hash(columns).alias("leaf"), forged.alias("forged"))
    manifest = build(leaves, ["doc_id", "leaf", "forged"])
    root = F.lit(manifest.root).cast("string")
    folded = fold(F.coalesce("forged", "leaf"), F.col("steps"))
    found = proofs(manifest).select("doc_id", "leaf", "subroot", root.alias("root"), sha256_hex(proof_text(F.col("steps"))).alias("proof_sha256"),
                                    folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 8, top_levels: int = 4) -> str:
    """The same in SQL, for trees of up to 8 ** 8 leaves and up to 8 ** 4 trees."""
    value = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = " || ".join(value.format(name) for name in LEAF_COLUMNS)
    forged = " || ".join(value.format(lower if name == "text" else name) for name in LEAF_COLUMNS)
    crc = ("xor(4294967295, list_reduce([4294967295] || [ord(x) for x in string_split(cast(doc_id as varchar), '')], lambda crc, b:"
           " list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, u: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)))")
    parts = [f"""hashed as (select doc_id, coalesce('=' || lang, '') as tree, sha256({leaf}) as hash,
                            case when {crc} % {TAMPERED} = 0 then sha256({forged}) end as forged from documents)""",
             """t0 as (select *, row_number() over (partition by tree order by doc_id nulls first, hash, forged nulls first) - 1 as idx,
                       count(*) over (partition by tree) as n from hashed)"""]

    def climb(stem: str, count: int):
        for k in range(count):
            near = f"over (partition by tree, idx // {FAN} order by idx rows between"
            parts.append(f"""{stem}s{k} as (select *, case when n > 1 then coalesce(string_agg(hash, '') {near} unbounded preceding and 1 preceding), '') end as l,
                             case when n > 1 then coalesce(string_agg(hash, '') {near} 1 following and unbounded following), '') end as r from {stem}{k})""")
            parts.append(f"""{stem}{k + 1} as (select tree, idx // {FAN} as idx, (n + {FAN - 1}) // {FAN} as n,
                             case when n > 1 then sha256(string_agg(hash, '' order by idx)) else min(hash) end as hash
                             from {stem}{k} group by tree, idx // {FAN}, n)""")

    climb("t", levels)
    parts.append(f"u0 as (select '{TOP}' as tree, tree as below, hash, row_number() over (order by tree) - 1 as idx, count(*) over () as n from t{levels})")
    climb("u", top_levels)
    joins = [f"join ts{k} on ts{k}.tree = d.tree and ts{k}.idx = d.idx // {FAN ** k}" for k in range(levels)]
    joins += ["join us0 on us0.below = d.tree"] + [f"join us{k} on us{k}.idx = us0.idx // {FAN ** k}" for k in range(1, top_levels)]
    steps = [f"ts{k}" for k in range(levels)] + [f"us{k}" for k in range(top_levels)]
    folds = ", ".join(f"case when {s}.l is null then f{i} else sha256({s}.l || f{i} || {s}.r) end as f{i + 1}" for i, s in enumerate(steps))
    proof = " || ".join(f"coalesce({s}.l || {s}.r, '')" for s in steps)
    return f"""with {', '.join(parts)},
        folded as (select d.doc_id, d.hash as leaf, us0.hash as subroot, (select hash from u{top_levels}) as root, sha256({proof}) as proof_sha256,
                          coalesce(d.forged, d.hash) as f0, {folds} from t0 d {' '.join(joins)})
        select doc_id, leaf, subroot, root, proof_sha256, f{len(steps)} as folded_root, f{len(steps)} = root as verified from folded"""


SQL = _sql()
