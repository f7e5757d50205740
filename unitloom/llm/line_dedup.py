r"""Line dedup by a segment-partition edit join.

Two lines are near when at most ``edits`` insertions, deletions or substitutions of a code point lead
from one to the other and both have at least ``least_chars`` of them.  A line is split into edits + 1
segments; a near line of the same or a greater length holds one of them unchanged, shifted by no more
than the edits before and after it allow.  So a line is indexed under its segments, and probes with its
substrings at those shifts for its own length and each shorter one.  Lines that share a key are compared
by edit distance in bit-parallel form, in a band of diagonals as wide as the edits.

Equal lines are one node.  A key's lines are compared with its first line; keys whose lines still lie
in different classes are then compared across classes.  A class is all lines that near lines connect.
Of a class the first occurrence in the corpus, by document id and then position, stays.

Everything is column functions; no Python runs on the executors.  Lines are told apart by 128 bits of
hash.  A null text has no lines, an empty one has one empty line; empty lines always stay.  A null id
comes before any other.  Rows that repeat an id are ordered by their place in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from unitloom.llm.common import ROW, free_name, join_by_row, table, with_row_key
from unitloom.llm.components import components
from unitloom.session import cut_lineage

EDITS, LEAST_CHARS = 2, 20


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the indexed line is, segment, shift): all places where a segment may lie."""
    out = []
    for shorter in range(edits + 1):
        for segment in range(edits + 1):
            left, right = segment, edits - segment
            for shift in range(max(-left, shorter - right), min(left, shorter + right) + 1):
                out.append((shorter, segment, shift))
    return out


#: Bytes per code point of a line as it is cut into segments, so that a cut need not walk the line.
WIDE = 4


def wide(line: Column) -> Column:
    return F.encode(line, "UTF-32")


def segment_keys(line: Column, edits: int, least_chars: int) -> Column:
    """Keys of a line: its own segments, and its substrings where near lines' segments may lie."""
    keys = [_key(wide(line), F.length(line), *map(F.lit, probe), edits, least_chars) for probe in probes(edits)]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _key(line: Column, length: Column, shorter: Column, segment: Column, shift: Column, edits: int, least_chars: int) -> Column:
    """The key of a line, given by :func:`wide` and its number of code points, at one of the :func:`probes`; null if it has no such place."""
    parts = edits + 1
    indexed = length - shorter
    base = F.floor(indexed / parts).cast("int")
    over = (indexed % parts) - (parts - segment)
    size = base + F.when(over >= 0, 1).otherwise(0)
    start = base * segment + F.greatest(over, F.lit(0)) + shift
    usable = (indexed >= least_chars) & (start >= 0) & (start + size <= length)
    return F.when(usable, F.xxhash64(segment, indexed, F.substr(line, start * WIDE + 1, size * WIDE)))


def keys_of(lines: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """(k1, key): a row per key of lines (k1, chars, wide), where equal keys of a line may repeat.

    The places are rows and not columns: one short expression is much faster than an array of one per place.
    """
    places = F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("shorter", "segment", "shift"), probe)]) for probe in probes(edits)]))
    keys = lines.select("k1", "chars", "wide", places).select(
        "k1", _key(F.col("wide"), F.col("chars"), F.col("shorter"), F.col("segment"), F.col("shift"), edits, least_chars).alias("key"))
    return keys.where("key IS NOT NULL")


#: Segments of which near lines share all but as many as there are edits, tested before lines are compared in full.
FINE = 8


def mostly_shared(x: Column, y: Column, x_length: Column, y_length: Column, edits: int) -> Column:
    """Whether all but ``edits`` of the segments of ``x`` lie in ``y`` where near lines have them; both as :func:`wide` gives them."""
    missing = F.lit(0)
    for segment in range(FINE):
        start, end = (F.floor(x_length * i / FINE).cast("int") for i in (segment, segment + 1))
        own = F.substring(x, start * WIDE + 1, (end - start) * WIDE)
        held = F.lit(False)
        for shift in range(-edits, edits + 1):
            inside = (start + shift >= 0) & (end + shift <= y_length)
            held = held | (inside & (F.substring(y, (start + shift) * WIDE + 1, (end - start) * WIDE) == own))
        missing = missing + F.when(held, 0).otherwise(1)
    return missing <= edits


def parities(line: Column) -> Column:
    """Bits that tell whether a line has an odd number of characters (``ones``) and of pairs of characters (``twos``) of a kind.

    An edit changes at most two characters and four pairs, and as many bits.
    """
    state = F.struct(F.lit(0).cast("long").alias("ones"), F.lit(0).cast("long").alias("twos"), F.lit(0).alias("before"))

    def step(state, c):
        flipped = [F.call_function("shiftleft", F.lit(1).cast("long"), kind.bitwiseAND(F.lit(63))) for kind in (c, state["before"] * 37 + c)]
        return F.struct(state["ones"].bitwiseXOR(flipped[0]).alias("ones"), state["twos"].bitwiseXOR(flipped[1]).alias("twos"), c.alias("before"))
    codes = F.transform(F.split(line, ""), lambda c: F.pmod(F.ascii(c), F.lit(65536)))
    return F.aggregate(codes, state, step)


def near(x: Column, y: Column, edits: int) -> Column:
    """Whether the edit distance of two texts is at most ``edits``.

    State d holds a bit per diagonal of the band, set where so much of both texts matches with at
    most d edits; a step takes one character of ``y`` and works on all diagonals at once.
    """
    width = 2 * edits + 1
    band = (1 << width) - 1
    # before any character, diagonal edits + d lies d characters of x ahead, which d deletions allow
    first = [sum(1 << (edits + ahead) for ahead in range(d + 1)) for d in range(edits + 1)]
    start = F.struct(*[F.lit(bits).alias(f"r{d}") for d, bits in enumerate(first)])

    def step(state, same):
        out = []
        for d in range(edits + 1):
            to = state[f"r{d}"].bitwiseAND(same)
            if d:
                before = state[f"r{d - 1}"]
                to = to.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(band))
            out.append(to)
        return F.struct(*[to.alias(f"r{d}") for d, to in enumerate(out)])

    def compared(both):
        def matching(c, j):
            """Bits of the diagonals on which the character of ``y`` equals that of ``x``."""
            bits = F.lit(0)
            for i in range(width):
                bits = bits + F.when(F.get(both["xs"], j + (i - edits)) == c, 1 << i).otherwise(0)
            return bits
        last = F.aggregate(F.transform(both["ys"], matching), start, step, lambda state: state[f"r{edits}"])
        end = F.size(both["xs"]) - F.size(both["ys"]) + edits
        return F.call_function("shiftright", last, end).bitwiseAND(F.lit(1)) == 1
    # a list of one, whose function sees both texts cut into characters once
    cut = F.array(F.struct(F.split(x, "").alias("xs"), F.split(y, "").alias("ys")))
    fits = F.abs(F.length(x) - F.length(y)) <= edits
    return fits & F.when(fits, F.get(F.transform(cut, compared), F.lit(0)))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return with_row_key(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select(ROW, "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _apart(near_pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Of pairs of lines (a, b with row and position of each), the near ones, compared in full."""
    sides = near_pairs.select("a", "b", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("a_row").alias("row"), F.col("a_pos").alias("pos")),
        F.struct(F.lit(1).alias("side"), F.col("b_row").alias("row"), F.col("b_pos").alias("pos")))).alias("s"))
    asked = sides.select("a", "b", "s.side", F.col("s.row").alias(ROW), "s.pos")
    # merged at every size: the texts are shuffled once, and a hot row key is split
    told = asked.hint("merge").join(texts.select(ROW, "text"), ROW).select(
        "a", "b", "side", F.get(F.split("text", "\n", -1), F.col("pos")).alias("line"))
    both = told.groupBy("a", "b").agg(
        F.max(F.when(F.col("side") == 0, F.col("line"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("line"))).alias("y"))
    # cheap to test, and most lines that only share a segment fail it
    both = both.select("a", "b", "x", "y", F.length("x").alias("xn"), F.length("y").alias("yn"), wide(F.col("x")).alias("xw"), wide(F.col("y")).alias("yw"))
    both = both.where(mostly_shared(F.col("xw"), F.col("yw"), F.col("xn"), F.col("yn"), edits))
    return both.where(near(F.col("x"), F.col("y"), edits)).select("a", "b")


def _with_parities(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines (id, row, pos) with the :func:`parities` of their texts, each line read once."""
    asked = ends.select("id", F.col("row").alias(ROW), "pos").distinct()
    told = asked.hint("merge").join(texts.select(ROW, "text"), ROW)
    return told.select("id", parities(F.get(F.split("text", "\n", -1), F.col("pos"))).alias("p")).select("id", "p.ones", "p.twos")


def line_classes(texts: DataFrame, lines: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """(node, component) of the lines that are near another; ``lines`` is written, a row per distinct line."""
    # length and wide form are columns of their own, taken once per line and not once per key
    long = _lines(texts).select(F.xxhash64("line").alias("k1"), F.length("line").alias("chars"), "line").where(F.col("chars") >= least_chars)
    long = long.select("k1", "chars", wide(F.col("line")).alias("wide"))
    # shuffled once: keys that several lines hold are found where they lie and meet their lines there
    keys = keys_of(long, edits, least_chars).repartition("key")
    shared = keys.groupBy("key").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("key", "low")
    met = cut_lineage(keys.join(shared.hint("shuffle_hash"), "key").distinct(), "met")

    def side(name):
        return lines.where(F.col("chars") >= least_chars).select(
            F.col("k1").alias(f"{name}_k"), F.col("id").alias(name), F.col("chars").alias(f"{name}_chars"),
            F.col("first.row").alias(f"{name}_row"), F.col("first.pos").alias(f"{name}_pos"))

    def resolved(pairs):
        found = pairs.join(side("a"), "a_k").join(side("b"), "b_k")
        return found.where((F.col("a") < F.col("b")) & (F.abs(F.col("a_chars") - F.col("b_chars")) <= edits)).select(
            "a", "b", "a_row", "a_pos", "b_row", "b_pos").distinct()

    pairs = met.where("k1 <> low").select(F.col("low").alias("a_k"), F.col("k1").alias("b_k")).distinct()
    pairs = pairs.unionByName(pairs.select(F.col("b_k").alias("a_k"), F.col("a_k").alias("b_k")))
    tried = cut_lineage(resolved(pairs), "pairs")
    links = cut_lineage(_apart(tried, texts, edits), "links")
    reached = components(links)
    classed = lines.where(F.col("chars") >= least_chars).join(reached, F.col("id") == F.col("node"), "left").select(
        "k1", "id", "chars", F.coalesce("component", "id").alias("component"), F.col("first.row").alias("row"), F.col("first.pos").alias("pos"))
    held = cut_lineage(met.select("key", "k1").join(cut_lineage(classed, "classes"), "k1"), "held")
    mixed = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    mixed = cut_lineage(held.join(cut_lineage(mixed, "keys"), "key"), "mixed")
    if mixed.isEmpty():
        return reached
    mixed = cut_lineage(mixed.join(cut_lineage(_with_parities(mixed, texts), "parities"), "id"), "mixed")

    def end(name):
        return mixed.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("id", "chars", "component", "row", "pos", "ones", "twos")])

    def differ(column):
        return F.bit_count(F.col(f"a_{column}").bitwiseXOR(F.col(f"b_{column}")))
    rest = end("a").join(end("b"), "key").where(
        (F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component")) & (F.abs(F.col("a_chars") - F.col("b_chars")) <= edits)
        & (differ("ones") <= 2 * edits) & (differ("twos") <= 4 * edits))
    rest = rest.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_row", "a_pos", "b_row", "b_pos").distinct()
    rest = cut_lineage(rest.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if rest.isEmpty():
        return reached
    more = cut_lineage(_apart(rest, texts, edits), "links")
    return reached if more.isEmpty() else components(links.unionByName(more))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS,
               least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row key, doc_id, n_lines, n_near, removed) of each row of a stored table.

    ``removed`` lists positions, from 0, of lines that go; ``n_near`` counts those whose class began
    with a different line.
    """
    texts = _texts(docs, doc_id, text)
    held = _lines(texts).where(F.col("line") != "")
    thin = cut_lineage(held.select(
        ROW, "doc_id", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), F.col("line")).alias("k2"),
        F.length("line").alias("chars")), "occurrences")
    place = F.struct(F.col("doc_id"), F.col(ROW).alias("row"), F.col("pos"))
    lines = thin.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.first("chars").alias("chars"))
    lines = cut_lineage(lines.withColumn("id", F.monotonically_increasing_id()), "lines")
    reached = line_classes(texts, lines, edits, least_chars)
    of = lines.join(reached, F.col("id") == F.col("node"), "left").select("k1", "k2", "id", "first", F.coalesce("component", "id").alias("class"))
    of = cut_lineage(of, "classes")
    begun = of.groupBy("class").agg(F.min(F.struct("first", "id")).alias("begin"))
    decided = cut_lineage(of.join(begun, "class").select("k1", "k2", "id", F.col("begin.first").alias("keep"), F.col("begin.id").alias("by")), "decided")
    gone = thin.join(decided, ["k1", "k2"]).where(place > F.col("keep")).groupBy(ROW).agg(
        F.array_sort(F.collect_list("pos")).alias("removed"), F.count(F.when(F.col("id") != F.col("by"), 1)).alias("n_near"))
    counts = texts.select(ROW, "doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    counts = counts.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    return counts.join(gone, ROW, "left").select(
        ROW, "doc_id", "n_lines", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("removed", F.expr("cast(array() AS array<int>)")).alias("removed"))


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the lines that go; null texts stay null."""
    name = free_name("_gone", docs.columns)
    met = join_by_row(docs, line_dedup(docs, doc_id, text, **settings).select(ROW, F.col("removed").alias(name)), "inner")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col(name), i))
    return met.withColumn(text, F.when(F.size(name) == 0, F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def op8_line_dedup(spark, folder: str) -> DataFrame:
    out = line_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "n_near",
                      F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


SQL = f"""
WITH RECURSIVE o AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents WHERE text IS NOT NULL),
d AS (SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first, length(line) AS n FROM o WHERE line <> '' GROUP BY line),
q AS (SELECT *, n // 3 AS third FROM d WHERE n >= {LEAST_CHARS}),
-- two edits leave the first, the middle or the last third of the shorter line whole
l AS (SELECT a.line AS x, b.line AS y FROM q a JOIN q b ON b.n BETWEEN a.n AND a.n + {EDITS} AND a.line <> b.line
      AND CASE WHEN left(a.line, a.third) = left(b.line, a.third) OR right(a.line, a.third) = right(b.line, a.third)
                 OR contains(b.line, substr(a.line, a.third + 1, a.n - 2 * a.third)) THEN levenshtein(a.line, b.line) ELSE 99 END <= {EDITS}),
k AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT line AS a, line AS c FROM d UNION SELECT r.a, k.y FROM r JOIN k ON r.c = k.x),
g AS (SELECT r.a AS line, min(d.first) AS keep, arg_min(d.line, d.first) AS by FROM r JOIN d ON r.c = d.line GROUP BY r.a),
e AS (SELECT o.doc_id, list(o.pos ORDER BY o.pos) AS gone, count(*) FILTER (WHERE g.by <> o.line) AS n_near
      FROM o JOIN g USING (line) WHERE struct_pack(doc_id := o.doc_id, pos := o.pos) > g.keep GROUP BY o.doc_id)
SELECT t.doc_id, CAST(coalesce(len(string_split(t.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(e.gone), 0) AS BIGINT) AS n_removed, coalesce(e.n_near, 0) AS n_near,
       coalesce(array_to_string(e.gone, ','), '') AS removed
FROM documents t LEFT JOIN e USING (doc_id)
"""
